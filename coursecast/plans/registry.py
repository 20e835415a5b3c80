"""Every registered query: how to build it on the test tables, and the SQL it must equal.

Queries without SQL (forests and sampling) are checked for their rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.functions import courses as C
from coursecast.functions import terms as TM
from coursecast.functions.names import clean_columns, key_columns
from coursecast.operators import accuracy as ACC
from coursecast.operators import aggregates as A
from coursecast.operators import features as FT
from coursecast.operators import filters as FL
from coursecast.operators import history as H
from coursecast.operators import joins as J
from coursecast.operators import models as M
from coursecast.operators import profile as P
from coursecast.operators import report as R
from coursecast.plans import scoring, standin, training
from coursecast.plans.oracle import FLOOR, bucket, coding, ridge, sql
from coursecast.schema import REPORT_NAMES, SECTION_SCHEMA, TARGET
from coursecast.sources import catalog, csv, results, sql_dump
from coursecast.sources.replace import move
from coursecast.sources.scratch import scratch_path
from coursecast.streaming.drop_folder import load_mixed_files, load_new_files

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}
FLOOR_YEAR = standin.FLOOR_YEAR


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        REGISTRY[name] = Query(build, oracle)
        return build

    return keep


def _report(spark: SparkSession, sf: str) -> DataFrame:
    scored = standin.scored(spark, sf).withColumnRenamed("actual", "act")
    return results.report_predictions(scored)


def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ACC.course_accuracy(standin.scored(spark, sf))


def _r6(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


# --- sources and sinks ------------------------------------------------------------------------

_TYPED = """
select cast(term as bigint) as term, term_desc, crn, subj, cast(crse as bigint) as crse,
       cast(sec as bigint) as sec, cast(credits as bigint) as credits, title,
       cast(act as bigint) as act, xl_act
from sections"""

_PER_TERM = """
select term, count(*) as n_rows, cast(sum(act) as bigint) as total_act, sum(xl_act) as total_xl
from sections group by term"""


def _per_term(df: DataFrame) -> DataFrame:
    return df.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("act").alias("total_act"),
        F.sum("xl_act").alias("total_xl"),
    )


def _csv_copy(spark: SparkSession, sf: str, name: str, folder: str = "") -> str:
    path = scratch_path(spark, name)
    standin.sections(spark, sf).write.option("header", True).csv(path + folder)
    return path


@query("s1_csv_scan", sql(_TYPED, "sections"))
def s1(spark, sf):
    return csv.load_csv(spark, _csv_copy(spark, sf, "s1"))


@query(
    "s2_clean_columns",
    sql("select term_desc, cast(sum(xl_act) as double) as xl_act, count(*) as n_rows from sections group by term_desc",
        "sections"),
)
def s2(spark, sf):
    raw = standin.sections(spark, sf).withColumnsRenamed({"term_desc": " Term  Desc.", "xl_act": "XL-(Act)/"})
    clean = clean_columns(raw)
    return clean.groupBy("term_desc").agg(F.sum("xl_act").alias("xl_act"), F.count(F.lit(1)).alias("n_rows"))


_S3_COLUMNS = ["term", "term_desc", "crn", "subj", "crse", "sec", "credits", "title", "act", "xl_act"]


def _s3_sql() -> str:
    rows = [
        f"""select {i} as ordinal, '{c}' as "column",
        case when count(*) filter (regexp_full_match(t, '-?[0-9]+')) = count(*) then 'INTEGER'
             when count(try_cast(t as double)) = count(t) then 'NUMERIC'
             when max(length(t)) <= 255 then 'VARCHAR(255)' else 'TEXT' end as sql_type,
        max(length(t)) as max_length
        from (select cast({c} as varchar) as t from sections)"""
        for i, c in enumerate(_S3_COLUMNS, start=1)
    ]
    return sql("\nunion all\n".join(rows), "sections")


@query("s3_infer_types", _s3_sql())
def s3(spark, sf):
    return csv.infer_types(csv.read_text_csv(spark, _csv_copy(spark, sf, "s3")))


@query("s4_table_load", sql(_PER_TERM, "sections"))
def s4(spark, sf):
    path = scratch_path(spark, "s4")
    csv.save_table(standin.sections(spark, sf), path)
    return _per_term(spark.read.parquet(path))


@query(
    "s5_csv_directory",
    sql("select count(*) as n_rows, cast(sum(act) as bigint) as total_act from sections", "sections"),
)
def s5(spark, sf):
    out = scratch_path(spark, "s5-out")
    loaded = csv.load_csv_dir(spark, _csv_copy(spark, sf, "s5"), out)
    names = sorted(r["table_name"] for r in loaded.filter("loaded").collect())
    # Each is a table of its own, stored by term: one reader over several of them would not find the terms.
    tables = [spark.read.parquet(f"{out}/{n}").select("act") for n in names]
    return reduce(DataFrame.unionByName, tables).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("act").alias("total_act"))


@query(
    "s5_many_files",
    sql("select replace(lower(term_desc), ' ', '_') as table_name, true as loaded, count(*) as n_rows, cast(sum(act) as bigint) as total_act "
        "from sections group by term_desc union all select 'nation', true, count(*), cast(sum(n_regionkey) as bigint) from nation "
        "union all select 'empty', false, null, null union all select 'nation', false, null, null", "sections"),
)
def s5_many(spark, sf):
    """A file per term, one of other columns, an empty one, and one whose name gives a table that is there already."""
    folder, out, parts = scratch_path(spark, "s5-many"), scratch_path(spark, "s5-many-out"), scratch_path(spark, "s5-parts")
    named = F.replace(F.lower("term_desc"), F.lit(" "), F.lit("_"))
    sections = standin.sections(spark, sf).withColumn("file", named).repartition("file")
    # The rows of a term meet in one task, as they make one file. It writes them as they come: its files are open side by
    # side, so that it need not sort all its rows by file.
    side_by_side = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(side_by_side)
    spark.conf.set(side_by_side, "100")
    try:
        sections.write.partitionBy("file").option("header", True).csv(parts)
    finally:
        spark.conf.set(side_by_side, was)
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    for name in ("nation", "nation.", "empty"):
        rows = nation if name != "empty" else nation.filter("false")
        rows.coalesce(1).write.option("header", True).csv(f"{parts}/file={name}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(parts).select("path").collect()
    for r in found:  # one part file each, moved to the folder under its table's name
        move(spark, r.path, f"{folder}/{r.path.split('file=')[1].split('/')[0]}.csv")
    loaded = csv.load_csv_dir(spark, folder, out).select("table_name", "loaded")
    good = [r.table_name for r in loaded.filter("loaded").collect()]
    sums = [
        spark.read.parquet(f"{out}/{n}").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("n_regionkey" if n == "nation" else "act").cast("long").alias("total_act")
        ).select(F.lit(n).alias("table_name"), F.lit(True).alias("loaded"), "*")
        for n in sorted(good)
    ]
    return loaded.join(reduce(DataFrame.unionByName, sums), ["table_name", "loaded"], "left")


_S6_VALUES = ", ', ', ".join(
    [
        "cast(term as varchar)", "'''' || replace(term_desc, '''', '''''') || ''''", "cast(crn as varchar)",
        "'''' || replace(subj, '''', '''''') || ''''", "cast(crse as varchar)", "'''' || sec || ''''",
        "cast(credits as varchar)", "'''' || replace(title, '''', '''''') || ''''", "cast(act as varchar)",
        "coalesce(cast(xl_act as varchar), 'NULL')",
    ]
)


@query(
    "s6_sql_dump_lines",
    sql(f"select concat('INSERT INTO sections ({', '.join(_S3_COLUMNS)}) VALUES (', {_S6_VALUES}, ');') as line from sections",
        "sections"),
)
def s6(spark, sf):
    return sql_dump.sql_dump_lines(standin.sections(spark, sf), "sections")


@query("s7_sql_dump_source", sql("select * from sections", "sections"))
def s7(spark, sf):
    path, rows = scratch_path(spark, "s7"), standin.sections(spark, sf)
    sql_dump.write_sql_dump(rows, "sections", path)
    return sql_dump.read_sql_dump(spark, f"{path}/data", rows.schema)


@query("s7_sql_dump_two_tables", sql("select * from sections", "sections"))
def s7_two(spark, sf):
    """Sections and another table in one folder, the other with CRLF line ends."""
    path, rows = scratch_path(spark, "s7-two"), standin.sections(spark, sf)
    other = spark.read.parquet(f"{sf}/nation.parquet")
    sql_dump.sql_dump_lines(rows, "sections").write.text(f"{path}/a")
    sql_dump.sql_dump_lines(other, "nation").write.option("lineSep", "\r\n").text(f"{path}/b")
    return sql_dump.read_sql_dump(spark, f"{path}/*", rows.schema, table="sections")


@query(
    "s8_query_source",
    sql("select subj, crse, max(act) as most from sections where term >= 199900 and act > 5 group by subj, crse",
        "sections"),
)
def s8(spark, sf):
    text = "select subj, crse, max(act) as most from {s} where term >= :first and act > :least group by subj, crse;"
    return catalog.run_query(spark, text, {"first": 199900, "least": 5}, s=standin.sections(spark, sf))


_RANKED = """
select place as "Rank", subj as "Subject", {crse} as "Course", avg_enrollment as "Avg_Enrollment",
       predictions_count as "Num_Predictions", std_enrollment as "Std_Enrollment",
       variability as "Variability_Pct", mae as "MAE", mape as "MAPE"
from ranked"""


@query("s9_accuracy_csv", sql(_RANKED.format(crse="cast(crse as varchar)"), "ranked"))
def s9(spark, sf):
    path = scratch_path(spark, "s9")
    results.write_accuracy(ACC.ranked_accuracy(_accuracy(spark, sf)), path)
    return results.read_accuracy(spark, path)


_S10 = """
select "Term", "Subject", cast("Course" as varchar) as "Course", cast("Credits" as double) as "Credits",
       "Predicted_Enrollment", cast("Actual_Enrollment" as double) as "Actual_Enrollment"
from report"""
_S10_COLUMNS = list(REPORT_NAMES.values())


@query("s10_predictions_json", sql(_S10, "report"))
def s10_json(spark, sf):
    path = scratch_path(spark, "s10")
    standin.scored(spark, sf).withColumnRenamed("actual", "act").write.json(path)
    return results.report_predictions(results.read_predictions_json(spark, path)).select(_S10_COLUMNS)


@query("s10_predictions_csv", sql(_S10, "report"))
def s10_csv(spark, sf):
    path = scratch_path(spark, "s10-csv")
    results.write_predictions_csv(_report(spark, sf), path)
    return results.report_predictions(results.read_predictions_csv(spark, path)).select(_S10_COLUMNS)


@query("s10_predictions_mixed", sql(f"select * from ({_S10}) union all select * from ({_S10})", "report"))
def s10_mixed(spark, sf):
    """One folder with files of both layouts."""
    path, report = scratch_path(spark, "s10-mixed"), _report(spark, sf)
    results.write_predictions_csv(report.select(_S10_COLUMNS), path)
    report.select(_S10_COLUMNS[::-1]).write.mode("append").option("header", True).csv(path)
    return results.report_predictions(results.read_predictions_csv(spark, path)).select(_S10_COLUMNS)


@query("s11_drop_folder", sql(_PER_TERM, "sections"))
def s11(spark, sf):
    folder, out, mark = (scratch_path(spark, f"s11-{n}") for n in ("in", "out", "checkpoint"))
    rows = standin.sections(spark, sf)
    rows.write.option("header", True).csv(folder)
    for _ in range(2):  # the second run finds nothing new
        load_new_files(spark, folder, out, mark, rows.schema)
    return _per_term(spark.read.parquet(out))


@query(
    "s11_mixed_folder",
    sql("select 'sections' as table_name, count(*) as n_rows, cast(sum(act) as bigint) as total from sections "
        "union all select 'nation', count(*), cast(sum(n_regionkey) as bigint) from nation "
        "union all select 'region', count(*), cast(sum(r_regionkey) as bigint) from region union all select 'rejected', 1, 0", "sections"),
)
def s11_mixed(spark, sf):
    """Files of three tables, one with its columns in another order, and an odd one, in one folder."""
    folder, out, mark = (scratch_path(spark, f"s11-mixed-{n}") for n in ("in", "out", "checkpoint"))
    sections, nation, region = standin.sections(spark, sf), *(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    odd = region.select(F.col("r_name").alias("something"), F.col("r_regionkey").alias("else"))
    for rows in (sections, nation.select(*nation.columns[::-1]), region, odd.coalesce(1)):
        rows.write.mode("append").option("header", True).csv(folder)
    shapes = {"sections": sections.schema, "nation": nation.schema, "region": region.schema}
    for _ in range(2):  # the second run finds nothing new
        load_mixed_files(spark, folder, out, mark, shapes)
    totals = {"sections": F.sum("act"), "nation": F.sum("n_regionkey"), "region": F.sum("r_regionkey"), "rejected": F.lit(0)}
    return reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("n_rows"), total.cast("long").alias("total")).select(F.lit(n).alias("table_name"), "*")
        for n, total in totals.items()
    ])


# --- catalog and profiles ---------------------------------------------------------------------

_CATALOG = sorted([*standin.STORED, "sections", "term_context", "year_context"])
_CONTEXTS = ["sections", "term_context", "year_context"]


def _catalog_sql(body: str) -> str:
    columns = " union all ".join(
        f"select '{t}' as table_name, column_name, row_number() over () as ordinal from (describe {t})"
        for t in _CATALOG
    )
    counts = " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in _CATALOG)
    flags = """
    select table_name, bool_or(column_name like '%subj%') as has_subj,
           bool_or(column_name like '%crse%' or column_name like '%course%') as has_crse,
           bool_or(column_name = 'term') as has_term,
           bool_or(column_name like '%semester%' or column_name = 'term') as has_semester,
           bool_or(column_name like '%year%' or column_name = 'term') as has_year,
           bool_or(column_name like '%enrollment%' or column_name like '%headcount%' or column_name = 'act')
             as has_enrollment
    from cols group by table_name"""
    return sql(body, *_CONTEXTS, cols=columns, counts=counts, flags=flags)


@query(
    "c1_table_columns",
    _catalog_sql("select table_name, cast(ordinal as integer) as ordinal, column_name, row_count "
                 "from cols join counts using (table_name)"),
)
def c1(spark, sf):
    tables = standin.catalog(spark, sf)
    return catalog.table_columns(spark, tables).join(catalog.row_counts(tables), "table_name")


@query(
    "c1_auto_schema",
    _catalog_sql("select table_name, cast(ordinal as integer) as ordinal, column_name, '' as description from cols"),
)
def c1_auto(spark, sf):
    return catalog.schema_rows(spark, standin.catalog(spark, sf))


@query(
    "c2_first_table_with_columns",
    sql("select distinct 'sections' as table_name, term, term_desc from sections", "sections"),
)
def c2(spark, sf):
    tables = standin.catalog(spark, sf)
    name = catalog.first_table_with(tables, ["term", "term_desc"])
    return FL.semesters(tables[name]).select(F.lit(name).alias("table_name"), "term", "term_desc")


@query(
    "c3_key_columns",
    sql("select term as \"TERM\", subj as \"Subject_Subj\", crse as \"Course\", cast(sum(act) as bigint) as act_enrollment "
        "from sections group by term, subj, crse", "sections"),
)
def c3(spark, sf):
    renamed = standin.sections(spark, sf).withColumnsRenamed(
        {"term": "TERM", "subj": "Subject_Subj", "crse": "Course", "act": "Total_Headcount"}
    )
    roles = key_columns(renamed.columns)
    return A.course_term(renamed).select(roles["term"], roles["subj"], roles["crse"], TARGET)


@query("c4_table_metadata", _catalog_sql("select * from flags join counts using (table_name)"))
def c4(spark, sf):
    return catalog.table_roles(standin.catalog(spark, sf))


@query(
    "c4_counts_by_file",
    sql("select count(*) as n_rows, 2 as tables, true as only_new from (select * from sections union all select * from sections)", "sections"),
)
def c4_files(spark, sf):
    """Counts kept by file: after a second load only its files are counted."""
    path, kept = scratch_path(spark, "c4-table"), scratch_path(spark, "c4-counts")
    rows = standin.sections(spark, sf)
    rows.write.parquet(path)
    before = spark.read.parquet(path)
    first, old = catalog.counted_files(before, kept).count(), set(before.inputFiles())
    rows.write.mode("append").parquet(path)
    after = spark.read.parquet(path)
    counts = catalog.counted_files(after, kept)
    only_new = spark.read.parquet(kept).count() == first + len(set(after.inputFiles()) - old)
    return counts.agg(F.sum("n_rows").alias("n_rows"), F.lit(2).alias("tables"), F.lit(only_new).alias("only_new"))


@query(
    "c5_primary_table",
    _catalog_sql("""
    select table_name, (has_subj::int + has_crse::int + has_semester::int + has_year::int + has_enrollment::int) * 10
             + least(row_count / 1000, 10.0) as score
    from flags join counts using (table_name)
    where has_subj and has_crse and has_semester and has_enrollment
    order by score desc, table_name limit 1"""),
)
def c5(spark, sf):
    return catalog.primary_table(catalog.table_roles(standin.catalog(spark, sf)))


_C6 = {f.name: f.dataType.simpleString() for f in SECTION_SCHEMA.fields} | {"crn": "bigint"}


@query(
    "c6_feature_profile",
    sql(" union all ".join(
        f"""select '{c}' as column_name, '{t}' as data_type, count(*) - count({c}) as n_null,
        round((count(*) - count({c})) * 100.0 / count(*), 6) as pct_null, count(distinct {c}) as n_distinct
        from sections""" for c, t in _C6.items()), "sections"),
)
def c6(spark, sf):
    return P.feature_profile(standin.sections(spark, sf)).withColumns(_r6("pct_null"))


@query(
    "c6_sketched_profile",
    sql(" union all ".join(
        f"""select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, true as near, (select count(distinct term) from sections) as terms
        from sections""" for c in _C6 if c != "term"), "sections"),
)
def c6_sketched(spark, sf):
    """Profiles from sketches kept per term, added in two turns; distinct counts within 3 % of the exact ones."""
    path, kept = scratch_path(spark, "c6-sections"), scratch_path(spark, "c6-sketches")
    csv.save_table(standin.sections(spark, sf), path)
    stored = spark.read.parquet(path)
    first = P.refresh_sketches(stored.filter("term < 199900"), kept)
    second = P.refresh_sketches(stored, kept)
    terms = len(first) + len(second) if not P.refresh_sketches(stored, kept) else -1
    estimate = P.sketched_profile(spark.read.parquet(kept))
    exact = P.feature_profile(stored).select("column_name", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return estimate.join(exact, "column_name").select("column_name", "n_rows", "n_null", near.alias("near"), F.lit(terms).cast("long").alias("terms"))


@query(
    "c7_target_describe",
    sql("""select count(act_enrollment) as n, avg(act_enrollment) as mean,
        round(stddev_samp(act_enrollment), 6) as std, min(act_enrollment) as least,
        cast(quantile_cont(act_enrollment, 0.25) as double) as q25,
        cast(quantile_cont(act_enrollment, 0.5) as double) as q50,
        cast(quantile_cont(act_enrollment, 0.75) as double) as q75, max(act_enrollment) as most
        from features""", "features"),
)
def c7(spark, sf):
    return P.describe_target(standin.features(spark, sf)).withColumns(_r6("std"))


@query(
    "c8_year_distribution",
    sql("select cast(floor(term / 100) as integer) as year, count(*) as n_rows, floor(term / 100) < 1998 as below_floor "
        "from sections group by all", "sections"),
)
def c8(spark, sf):
    return P.year_distribution(standin.sections(spark, sf), FLOOR_YEAR)


@query(
    "c9_title_distribution",
    sql("select title, count(*) as n_rows, avg(act) as mean_act, min(act) as min_act, max(act) as max_act, "
        "count(act) as n_act from sections group by title", "sections"),
)
def c9(spark, sf):
    return P.title_distribution(standin.sections(spark, sf))


# --- filters and functions --------------------------------------------------------------------


@query("f1_year_floor", sql(f"select * from sections where term >= {FLOOR}", "sections"))
def f1(spark, sf):
    return FL.since_year(standin.sections(spark, sf), FLOOR_YEAR)


_TERMS = [199840, 199910, 199940, 200010]


@query(
    "f2_training_rows",
    sql("select * from sections where term in (199840, 199910, 199940, 200010) and act > 10", "sections"),
)
def f2(spark, sf):
    return FL.training_rows(standin.sections(spark, sf), _TERMS)


@query(
    "f3_season",
    sql("select term, crn, subj, crse, act from sections where right(cast(term as varchar), 2) = '40'", "sections"),
)
def f3(spark, sf):
    return FL.in_season(standin.sections(spark, sf), "spring").select("term", "crn", "subj", "crse", "act")


@query(
    "f4_subject_sections",
    sql("select term, crn, subj, crse, sec, act from sections where subj = 'MEDIUM' and term = 199940", "sections"),
)
def f4(spark, sf):
    rows = FL.subject_sections(standin.sections(spark, sf), "MEDIUM", 199940)
    return rows.select("term", "crn", "subj", "crse", "sec", "act")


@query("f5_present", sql("select term, crn, xl_act from sections where xl_act is not null and crn is not null", "sections"))
def f5(spark, sf):
    return FL.present(standin.sections(spark, sf), "xl_act", "crn").select("term", "crn", "xl_act")


@query(
    "f6_numeric_target",
    sql("select term, crn, cast(act as double) as act_enrollment from sections where xl_act is not null", "sections"),
)
def f6(spark, sf):
    text = F.when(F.col("xl_act").isNull(), "n/k").otherwise(F.col("act").cast("string"))
    rows = standin.sections(spark, sf).withColumn("act", text)
    return FL.with_target(rows, "act").select("term", "crn", TARGET)


@query("f7_normalize_input", sql("select term, crn, subj, crse, 3 as credits, 0 as act from sections", "sections"))
def f7(spark, sf):
    rows = standin.sections(spark, sf).select(
        F.col("term").alias("TERM"), F.col("crn").alias("CRN"), F.col("subj").alias("Subj"), "crse"
    )
    return FL.normalize_input(rows)


@query(
    "f8_term_year",
    sql("select crn, case when xl_act is null then null else cast(floor(term / 100) as integer) end as year, "
        "cast(floor(term / 100) as integer) - case when term % 100 = 10 then 1 else 0 end as calendar_year "
        "from sections", "sections"),
)
def f8(spark, sf):
    text = F.when(F.col("xl_act").isNull(), "").otherwise(F.concat(F.col("term").cast("string"), F.lit(".0")))
    return standin.sections(spark, sf).select(
        "crn", TM.term_year(TM.term_number(text)).alias("year"), TM.calendar_year(F.col("term")).alias("calendar_year")
    )


@query(
    "f9_season_label",
    sql("""select term, case term % 100 when 10 then 'fall' when 40 then 'spring' else 'term' || (term % 100) end as season,
        case term % 100 when 10 then 'fall' when 40 then 'spring' end || '_' || (term // 100) as label,
        count(*) as n_rows from sections group by all""", "sections"),
)
def f9(spark, sf):
    term = F.col("term")
    return standin.sections(spark, sf).groupBy(
        "term", TM.season(term).alias("season"), TM.term_label(term).alias("label")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "f10_subject_code",
    sql("select crn, case when credits = 1 then null else subj end as subj from sections", "sections"),
)
def f10(spark, sf):
    dirty = F.when(F.col("credits") == 1, "   ").otherwise(F.concat(F.lit("  "), F.lower("subj"), F.lit(" ")))
    return standin.sections(spark, sf).select("crn", C.subject_code(dirty).alias("subj"))


def _course_text() -> Column:
    end = F.when(F.col("credits") == 1, "H ").when(F.col("credits") == 2, ".5").otherwise(".0")
    return F.concat(F.lit(" "), F.col("crse").cast("string"), end)


@query(
    "f11_course_number",
    sql("""select crn, cast(crse as varchar) || case credits when 1 then 'H' when 2 then '.5' else '' end as course
        from sections""", "sections"),
)
def f11(spark, sf):
    return standin.sections(spark, sf).select("crn", C.course_number(_course_text()).alias("course"))


@query(
    "f12_course_sort_key",
    sql("""select crn, case credits when 2 then cast(crse as bigint) * 10 + 5 when 3 then null
        else cast(crse as bigint) end as course_order from sections""", "sections"),
)
def f12(spark, sf):
    text = F.when(F.col("credits") == 3, "TBA").otherwise(_course_text())
    return standin.sections(spark, sf).select("crn", C.course_sort_key(text).alias("course_order"))


@query(
    "f13_whole_students",
    sql("select term, subj, crse, cast(round_even(act_enrollment / 2, 0) as bigint) as students from features", "features"),
)
def f13(spark, sf):
    half = F.col(TARGET) / 2
    return standin.features(spark, sf).select("term", "subj", "crse", C.students(half).alias("students"))


@query("f14_report_names", sql("select * from report", "report"))
def f14(spark, sf):
    return _report(spark, sf)


@query("f15_nan_to_null", sql("select crn, xl_act from sections", "sections"))
def f15(spark, sf):
    rows = standin.sections(spark, sf).select("crn", F.coalesce("xl_act", F.lit(float("nan"))).alias("xl_act"))
    return FL.nan_to_null(rows)


@query("f16_semesters", sql("select distinct term, term_desc from sections", "sections"))
def f16(spark, sf):
    return FL.semesters(standin.sections(spark, sf))


_NAMES_SQL = " union all ".join(f"select '{k}' as code, '{v}' as name" for k, v in standin.NAMES.items())


@query(
    "f17_departments",
    sql("select code, name from names where code in (select upper(trim(subj)) from sections)", "sections", names=_NAMES_SQL),
)
def f17(spark, sf):
    return FL.departments(standin.sections(spark, sf), standin.NAMES)


@query(
    "f18_department_label",
    sql("""select subj, crse, coalesce(name, subj || ' Department') as report_name, coalesce(name, subj) as screen_name,
        count(*) as n_sections from sections left join names on subj = code group by all""",
        "sections", names=_NAMES_SQL),
)
def f18(spark, sf):
    subj = F.col("subj")
    return standin.sections(spark, sf).groupBy("subj", "crse").agg(F.count(F.lit(1)).alias("n_sections")).select(
        "subj", "crse",
        FL.department_label(subj, standin.NAMES, "report").alias("report_name"),
        FL.department_label(subj, standin.NAMES, "code").alias("screen_name"),
        "n_sections",
    )


# --- joins ------------------------------------------------------------------------------------


@query(
    "j1_joinable_tables",
    _catalog_sql("select table_name, has_term, has_year, has_semester, row_count from flags join counts using (table_name) "
                 "where table_name <> 'sections' and (has_term or has_year or has_semester)"),
)
def j1(spark, sf):
    roles = catalog.table_roles(standin.catalog(spark, sf))
    found = catalog.joinable_tables(roles, "sections")
    return found.join(roles.select("table_name", "row_count"), "table_name")


@query(
    "j2_temporal_join",
    sql(f"""select s.*, t.n_orders as by_term_n_orders, t.revenue as by_term_revenue,
        r.priority as repeated_priority, r.n_orders as repeated_n_orders, r.revenue as repeated_revenue
        from sections s left join term_context t on s.term = t.term
        left join (select * from repeated_context qualify row_number() over (partition by term
                   order by priority desc nulls last, n_orders desc nulls last, revenue desc nulls last) = 1) r
          on s.term = r.term
        where s.term >= {FLOOR}""", "sections", "term_context", "repeated_context"),
)
def j2(spark, sf):
    context = {
        "by_term": standin.term_context(spark, sf),
        "repeated": standin.repeated_context(spark, sf),
        "unrelated": standin.table(spark, sf, "nation"),
    }
    return J.temporal_join(standin.sections(spark, sf), context, FLOOR_YEAR)


@query(
    "j2_fan_out",
    sql(f"""select s.*, r.priority as repeated_priority, r.n_orders as repeated_n_orders, r.revenue as repeated_revenue
        from sections s left join repeated_context r on s.term = r.term where s.term >= {FLOOR}""",
        "sections", "repeated_context"),
)
def j2_fan_out(spark, sf):
    context = {"repeated": standin.repeated_context(spark, sf)}
    return J.temporal_join(standin.sections(spark, sf), context, FLOOR_YEAR, fan_out=True)


@query(
    "j2_null_safe",
    sql("""select s.* replace (case when crn % 50 = 0 then null else s.term end as term),
        t.n_orders as by_term_n_orders, t.revenue as by_term_revenue from sections s
        left join (select term, n_orders, revenue from term_context union all select null, 0, 0.0) t
          on (case when crn % 50 = 0 then null else s.term end) is not distinct from t.term""",
        "sections", "term_context"),
)
def j2_null_safe(spark, sf):
    rows = standin.sections(spark, sf)
    rows = rows.withColumn("term", F.when(F.col("crn") % 50 != 0, F.col("term")))
    by_term = standin.term_context(spark, sf)
    none = by_term.limit(1).select(*[F.lit(None if f.name == "term" else 0).cast(f.dataType).alias(f.name) for f in by_term.schema])
    return J.temporal_join(rows, {"by_term": by_term.unionByName(none)}, None, null_safe=True)


@query(
    "j2_temporal_join_year_semester",
    sql(f"""select f.term // 100 as year, f.term % 100 as semester, f.subj, f.crse, f.act_enrollment,
        y.n_orders as by_year_n_orders, y.revenue as by_year_revenue
        from features f left join year_context y on f.term // 100 = y.year and f.term % 100 = y.semester""",
        "features", "year_context"),
)
def j2_year(spark, sf):
    term = F.col("term")
    rows = standin.features(spark, sf).select(
        TM.term_year(term).alias("year"), (term % 100).alias("semester"), "subj", "crse", TARGET
    )
    return J.temporal_join(rows, {"by_year": standin.year_context(spark, sf)}, FLOOR_YEAR)


@query(
    "j2_training_data",
    sql(f"""select s.*, n_orders as term_context_n_orders, revenue as term_context_revenue
        from sections s left join term_context t on s.term = t.term where s.term >= {FLOOR}""",
        "sections", "term_context"),
)
def j2_discovered(spark, sf):
    tables = standin.catalog(spark, sf)
    tables.pop("year_context")  # has no term, and the section table no year
    return training.training_data(spark, tables=tables, floor_year=FLOOR_YEAR)


@query(
    "j3_attach_predictions",
    sql("select s.term, s.subj, s.crse, s.crn, s.act, p.prediction from sections s "
        "left join scored p on s.term = p.term and s.subj = p.subj and s.crse = p.crse", "sections", "scored"),
)
def j3(spark, sf):
    rows = standin.sections(spark, sf).select("term", "subj", "crse", "crn", "act")
    return J.attach_predictions(rows, standin.scored(spark, sf))


@query(
    "j4_history_lookup",
    sql("""select p.term, p.subj, p.crse, p.prediction, h.y1998, h.y1999
        from scored p left join (
          select subj, crse, cast(sum(act) filter (term // 100 = 1998) as bigint) as y1998,
                 cast(sum(act) filter (term // 100 = 1999) as bigint) as y1999
          from sections where term // 100 in (1998, 1999) group by subj, crse) h
        on p.subj = h.subj and p.crse = h.crse""", "sections", "scored"),
)
def j4(spark, sf):
    predictions = standin.scored(spark, sf).select("term", "subj", "crse", "prediction")
    return J.with_history(predictions, A.history_pivot(standin.sections(spark, sf), [1998, 1999]))


@query(
    "j5_compare_actual",
    sql("""select p.term, p.subj, p.crse, p.prediction, cast(t.total as bigint) as total_act,
        case when total > 0 then abs(prediction - total) end as error,
        case when total > 0 then abs(prediction - total) / total * 100 end as error_pct
        from scored p left join (select term, subj, crse, sum(act)::bigint as total from sections group by all) t
        on p.term = t.term and p.subj = t.subj and p.crse = t.crse""", "sections", "scored"),
)
def j5(spark, sf):
    predictions = standin.scored(spark, sf).select("term", "subj", "crse", "prediction")
    return J.compare_actual(predictions, standin.sections(spark, sf))


@query(
    "j6_credits_lookup",
    sql("select distinct s.subj, s.crse, case when s.crse = 204 then 3 else c.credits end as credits "
        "from sections s join (select subj, crse, max(credits) as credits from sections group by all) c "
        "on s.subj = c.subj and s.crse = c.crse", "sections"),
)
def j6(spark, sf):
    rows = standin.sections(spark, sf)
    unknown = rows.withColumn("credits", F.when(F.col("crse") == 204, 0).otherwise(F.col("credits")))
    return J.with_credits(A.distinct_courses(rows), unknown)


# --- aggregations -----------------------------------------------------------------------------


@query("a1_course_term", sql("select * from features", "features"))
def a1(spark, sf):
    return standin.features(spark, sf)


@query(
    "a1_course_term_carry",
    sql(f"""select f.*, n_orders as by_term_n_orders, revenue as by_term_revenue
        from features f left join term_context t on f.term = t.term""", "features", "term_context"),
)
def a1_carry(spark, sf):
    context = {"by_term": standin.term_context(spark, sf)}
    return training.features_with_context(standin.sections(spark, sf), context, FLOOR_YEAR)


@query(
    "a1_section_grain",
    sql("select term, subj, crse, sec, cast(act as bigint) as act_enrollment, credits from sections", "sections"),
)
def a1_section(spark, sf):
    return A.course_term(standin.sections(spark, sf), grain="section")


@query(
    "a2_course_total",
    sql("select cast(sum(act) as bigint) as total_act from sections where subj = 'PROMO' and crse = 210 and term = 199940",
        "sections"),
)
def a2(spark, sf):
    return A.course_total(standin.sections(spark, sf), "PROMO", 210, 199940)


@query(
    "a3_prediction_input",
    sql("""select term, subj, crse, cast(sum(act) as bigint) as act, avg(credits) as credits from sections
        where term // 100 = 1999 and right(cast(term as varchar), 2) = '40'
        group by term, subj, crse having sum(act) >= 10""", "sections"),
)
def a3(spark, sf):
    return A.prediction_input(standin.sections(spark, sf), 1999, "spring")


@query(
    "a4_enrollment_by_term",
    sql("select term, term_desc, cast(sum(coalesce(act, 0)) as bigint) as total_enrollment from sections "
        "where term // 100 >= 1998 group by term, term_desc", "sections"),
)
def a4(spark, sf):
    return A.enrollment_by_term(standin.sections(spark, sf), FLOOR_YEAR)


@query(
    "a5_numeric_series",
    sql("""select term, cast(sum(crn) as bigint) as crn, cast(sum(crse) as bigint) as crse,
        cast(sum(credits) as bigint) as credits, cast(sum(act) as bigint) as act,
        coalesce(sum(xl_act), 0) as xl_act from sections group by term""", "sections"),
)
def a5(spark, sf):
    return A.numeric_series(standin.sections(spark, sf))


@query(
    "a6_history_by_year",
    sql("""select subj, crse, term // 100 as hist_year, cast(sum(act) as bigint) as total_enrollment from sections
        where term // 100 in (1997, 1998, 1999) and (subj, crse) in
          (select (subj, crse) from scored where term = 199940 and prediction > actual)
        group by all""", "sections", "scored"),
)
def a6(spark, sf):
    pairs = standin.scored(spark, sf).filter("term = 199940 and prediction > actual")
    return A.history_by_year(standin.sections(spark, sf), [1997, 1998, 1999], pairs)


@query(
    "a7_title_conflicts",
    sql("""select distinct s.subj, s.crse, n as title_count, title from sections s
        join (select subj, crse, count(distinct title) as n from sections group by all having n > 1) c
        on s.subj = c.subj and s.crse = c.crse""", "sections"),
)
def a7(spark, sf):
    return A.title_conflicts(standin.sections(spark, sf))


@query(
    "a8_duplicate_crns",
    sql("select term, crn, count(*) as occurrence_count from sections group by term, crn having count(*) > 1", "sections"),
)
def a8(spark, sf):
    return A.duplicate_crns(standin.sections(spark, sf))


@query(
    "a9_verdict",
    sql("""select check_name, n_bad, n_bad = 0 as passed from (
          select 'title_consistency' as check_name, count(*) as n_bad from
            (select subj, crse from sections group by all having count(distinct title) > 1)
          union all select 'crn_uniqueness', count(*) from
            (select term, crn from sections group by all having count(*) > 1))""", "sections"),
)
def a9(spark, sf):
    return A.verdict(standin.sections(spark, sf))


@query("a10_course_accuracy", sql("select * from accuracy", "accuracy"))
def a10(spark, sf):
    return _accuracy(spark, sf)


@query(
    "a11_accuracy_bands",
    sql("""select band, courses, round(courses * 100.0 / total, 6) as pct from (
          select unnest(['good', 'moderate', 'poor']) as band, unnest([good, moderate, poor]) as courses, total from (
            select count(*) filter (mape < 20) as good, count(*) filter (mape >= 20 and mape < 40) as moderate,
                   count(*) filter (mape >= 40) as poor, count(*) as total from accuracy))""", "accuracy"),
)
def a11(spark, sf):
    return ACC.accuracy_bands(_accuracy(spark, sf)).withColumns(_r6("pct"))


@query(
    "a12_mape_summary",
    sql("select count(*) as courses, round(avg(mape), 6) as mean_mape, round(median(mape), 6) as median_mape from accuracy",
        "accuracy"),
)
def a12(spark, sf):
    return ACC.mape_summary(_accuracy(spark, sf)).withColumns(_r6("mean_mape", "median_mape"))


@query(
    "a13_trimmed_mape",
    sql("""select n as courses, count(*) as kept, round(avg(mape), 6) as trimmed_mape from
        (select *, count(*) over () as n from ranked) where n <= 10 or place <= n - 10 group by n""", "ranked"),
)
def a13(spark, sf):
    return ACC.trimmed_mape(_accuracy(spark, sf)).withColumns(_r6("trimmed_mape"))


@query(
    "a14_mape_histogram",
    sql("""select bin, mape_range, count(mape) as courses from
        (values (1, '0-10%', 0, 10), (2, '10-20%', 10, 20), (3, '20-30%', 20, 30), (4, '30-40%', 30, 40),
                (5, '40-50%', 40, 50), (6, '50-100%', 50, 100), (7, '100-500%', 100, 500), (8, '500%+', 500, 3000))
          b(bin, mape_range, low, high)
        left join accuracy on mape >= low and (mape < high or (bin = 8 and mape = high))
        group by bin, mape_range""", "accuracy"),
)
def a14(spark, sf):
    return ACC.mape_histogram(_accuracy(spark, sf))


@query(
    "a15_prediction_summary",
    sql("""select count(*) as total_predictions, count(distinct ("Subject", "Course")) as unique_courses,
        cast(sum("Predicted_Enrollment") as bigint) as predicted_total,
        round(avg("Predicted_Enrollment"), 6) as predicted_average from report""", "report"),
)
def a15(spark, sf):
    return A.prediction_summary(_report(spark, sf)).withColumns(_r6("predicted_average"))


@query(
    "a16_regression_metrics",
    sql("""select count(*) as n_rows, round(avg((actual - prediction) ** 2), 6) as mse,
        round(sqrt(avg((actual - prediction) ** 2)), 6) as rmse, round(avg(abs(actual - prediction)), 6) as mae,
        round(1 - avg((actual - prediction) ** 2) / var_pop(actual), 6) as r2, round(avg(pct_error), 6) as mape
        from rated""", "rated"),
)
def a16(spark, sf):
    return ACC.regression_metrics(standin.scored(spark, sf)).withColumns(_r6("mse", "rmse", "mae", "r2", "mape"))


@query("a17_forecast_year", sql('select max("Term") // 100 as forecast_year from report', "report"))
def a17(spark, sf):
    return A.forecast_year(_report(spark, sf))


# --- order, top-k, reshape --------------------------------------------------------------------


@query("w1_accuracy_rank", sql(_RANKED.format(crse="crse"), "ranked"))
def w1(spark, sf):
    return ACC.ranked_accuracy(_accuracy(spark, sf))


@query(
    "w2_best_and_worst",
    sql("""select case when place <= 10 then 'best' else 'worst' end as side, subj, crse, mape from
        (select *, count(*) over () as n from ranked) where place <= 10 or place > n - 10""", "ranked"),
)
def w2(spark, sf):
    rows = _accuracy(spark, sf)
    sides = [("best", ACC.best_courses(rows)), ("worst", ACC.worst_courses(rows))]
    best, worst = (df.select(F.lit(s).alias("side"), "subj", "crse", "mape") for s, df in sides)
    return best.unionByName(worst)


@query(
    "w3_top_courses",
    sql("select subj || ' ' || crse as course, mape from ranked where mape is not null and place <= 10", "ranked"),
)
def w3(spark, sf):
    return ACC.top_courses(_accuracy(spark, sf))


@query("w4_sorted_result", sql("select * from scored", "scored"))
def w4(spark, sf):
    return FL.sort_by(standin.scored(spark, sf), "subj", descending=True)


_W5 = """
select r."Subject" as subject, coalesce(name, r."Subject" || ' Department') as department,
       r."Subject" || ' ' || r."Course" as course, cast(r."Course" as bigint) as course_order,
       y1999, y2000, y2001, p.forecast
from (select distinct "Subject", "Course" from report) r
left join names on r."Subject" = code
left join (select "Subject" as subj, "Course" as crse, arg_max("Predicted_Enrollment", "Term") as forecast
           from report group by all) p on p.subj = r."Subject" and p.crse = r."Course"
left join (select subj, crse, cast(sum(act) filter (term // 100 = 1999) as bigint) as y1999,
                  cast(sum(act) filter (term // 100 = 2000) as bigint) as y2000,
                  cast(sum(act) filter (term // 100 = 2001) as bigint) as y2001
           from sections group by all) h on h.subj = r."Subject" and h.crse = r."Course"
"""


@query("w5_forecast_table", sql(_W5, "sections", "report", names=_NAMES_SQL))
def w5(spark, sf):
    years = A.history_years(2002)
    return R.forecast_table(_report(spark, sf), standin.sections(spark, sf), years, standin.NAMES)


@query(
    "w6_history_pivot",
    sql("""select subj, crse, cast(sum(act) filter (term // 100 = 1997) as bigint) as y1997,
        cast(sum(act) filter (term // 100 = 1998) as bigint) as y1998,
        cast(sum(act) filter (term // 100 = 1999) as bigint) as y1999
        from sections where term // 100 in (1997, 1998, 1999) group by subj, crse""", "sections"),
)
def w6(spark, sf):
    return A.history_pivot(standin.sections(spark, sf), A.history_years(2000))


@query(
    "w7_last_prediction",
    sql("""select "Subject" as subj, cast("Course" as varchar) as crse, arg_max("Predicted_Enrollment", "Term") as forecast
        from report group by "Subject", "Course" """, "report"),
)
def w7(spark, sf):
    return R.last_predictions(_report(spark, sf))


@query("w8_distinct_courses", sql("select distinct subj, crse from sections", "sections"))
def w8(spark, sf):
    return A.distinct_courses(standin.sections(spark, sf))


@query(
    "w9_sample_rows",
    sql("select * from sections order by term, crn, subj, crse, sec limit 3", "sections"),
)
def w9(spark, sf):
    return csv.sample_rows(standin.sections(spark, sf), by=["term", "crn", "subj", "crse", "sec"])


# --- features and models ----------------------------------------------------------------------


@query("m1_min_features", sql("select term, subj, crse, credits, act_enrollment from features", "features"))
def m1(spark, sf):
    data = standin.features(spark, sf)
    return data.select(*FT.min_features(data), TARGET)


@query(
    "m2_rich_features",
    sql(" union all ".join(
        f"""select '{c}' as column_name, count(distinct {c}) as n_distinct, cast(least(100, count(*) * 0.1) as double) as most_allowed,
        count(distinct {c}) <= least(100.0, count(*) * 0.1) as kept from sections"""
        for c in ("term_desc", "subj", "sec", "title")), "sections"),
)
def m2(spark, sf):
    return P.text_cardinality(standin.sections(spark, sf))


_M2_KEPT = "(select count(distinct {c}) <= least(100, 0.1 * count(*)) from sections)"


@query(
    "m2_chosen_features",
    sql("select feature from (values " + ", ".join(
        f"('{c}', {_M2_KEPT.format(c=c) if c in ('term_desc', 'sec', 'title') else 'true'})"
        for c in ("term", "subj", "crse", "credits", "term_desc", "sec", "title", "crn", "xl_act")) + ") as t(feature, kept) where kept", "sections"),
)
def m2_chosen(spark, sf):
    """The rich feature list of the sections."""
    chosen = FT.rich_features(standin.sections(spark, sf))
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


@query(
    "m3_hash_split",
    sql(f"select term, subj, crse, {bucket(100, 'term', 'subj', 'crse')} < 80 as in_training from features", "features"),
)
def m3(spark, sf):
    return standin.features(spark, sf).select("term", "subj", "crse", FT.in_training().alias("in_training"))


_CODING = coding("features", "features")
_CODES = {c: f"cast({c}_code as double) as {c}_code" for c in ("subj", "crse")}


@query(
    "m4_label_encode",
    sql(f"select term, subj, crse, {_CODES['subj']}, {_CODES['crse']} from scaled", "features", **_CODING),
)
def m4(spark, sf):
    data = standin.features(spark, sf)
    encoding = FT.fit_encoding(data.filter(FT.in_training()), FT.min_features(data))
    return encoding.transform(data).select("term", "subj", "crse", "subj_code", "crse_code")


_SCALED = [f"{c}_scaled" for c in ("term", "subj", "crse", "credits")]


@query(
    "m5_standard_scale",
    sql(f"select term, subj, crse, {', '.join(f'round({c}, 6) as {c}' for c in _SCALED)} from scaled",
        "features", **_CODING),
)
def m5(spark, sf):
    data = standin.features(spark, sf)
    stages = FT.fit_preprocessing(data.filter(FT.in_training()), FT.min_features(data))
    return stages.transform(data).select("term", "subj", "crse", *_SCALED).withColumns(_r6(*_SCALED))


def _ridge(spark: SparkSession, sf: str) -> M.Fitted:
    return M.fit(standin.features(spark, sf), "linear", grid={"alpha": (1.0,)})


@query(
    "m6_ridge_search",
    sql("select 'alpha=' || cast(alpha as varchar) as params, round(avg(mse), 6) as mse from fold_mse group by alpha",
        "features", **_CODING, **ridge([0.1, 1.0, 10.0, 100.0, 1000.0])),
)
def m6(spark, sf):
    return M.search_report(spark, M.fit(standin.features(spark, sf), "linear")).withColumns(_r6("mse"))


_SEARCHED = {"numTrees": (20,), "maxDepth": (5, 10), "minSplit": (2, 5, 10)}
_VALIDATION = f"{bucket(100, 'term', 'subj', 'crse')} >= 80"


def _forest(spark: SparkSession, sf: str) -> M.Fitted:
    return M.fit(standin.features(spark, sf), "tree", grid=_SEARCHED)


@query(
    "m7_forest",
    sql(f"""select subj, crse, count(*) as predictions_count, min(act_enrollment) as least, max(act_enrollment) as most,
        true as in_range from features where {_VALIDATION} group by subj, crse""", "features"),
)
def m7(spark, sf):
    """A searched forest: what does not depend on its random splits, and that no prediction leaves the labels' range."""
    data = standin.features(spark, sf)
    scored = M.predict(data.filter(~FT.in_training()), _forest(spark, sf))
    label = data.filter(FT.in_training()).agg(F.min(TARGET).alias("low"), F.max(TARGET).alias("high")).first()
    return scored.groupBy("subj", "crse").agg(
        F.count("*").alias("predictions_count"), F.min(TARGET).alias("least"), F.max(TARGET).alias("most"),
        F.bool_and(F.col("prediction").between(label.low, label.high)).alias("in_range"),
    )


_SPLITS = {
    "candidates": " union all ".join(
        f"select '{f}' as feature, {place} as place, {f}_scaled as x, act_enrollment as y from scaled_train"
        for place, f in enumerate(("term", "subj", "crse", "credits"))
    ),
    "per_value": "select feature, place, x, count(*) as n, sum(y) as s from candidates group by all",
    "cut": """select feature, place, x, sum(n) over w as n, sum(s) over w as s, lead(x) over (partition by feature order by x) as next,
        sum(n) over (partition by feature) as all_n, sum(s) over (partition by feature) as all_s
        from per_value window w as (partition by feature order by x rows unbounded preceding)""",
    "best": """select feature, (x + next) / 2 as threshold, s / n as low, (all_s - s) / (all_n - n) as high from cut
        where next is not null order by s * s / n + (all_s - s) * (all_s - s) / (all_n - n) desc, place, x limit 1""",
}


def _stump(spark: SparkSession, sf: str) -> M.Fitted:
    grid = {"numTrees": (1,), "maxDepth": (1,), "bootstrap": (False,)}
    return M.fit(standin.features(spark, sf), "tree", grid=grid)


_SIDE = "case feature when 'term' then term_scaled when 'subj' then subj_scaled when 'crse' then crse_scaled else credits_scaled end"


@query(
    "m7_single_split",
    sql(f"select term, subj, crse, round(case when {_SIDE} <= threshold then low else high end, 6) as prediction from scaled, best",
        "features", **_CODING, **_SPLITS),
)
def m7_single_split(spark, sf):
    """A forest of one tree with one split over all rows: the split that SQL finds too."""
    scored = M.predict(standin.features(spark, sf), _stump(spark, sf))
    return scored.select("term", "subj", "crse", F.round("prediction", 6).alias("prediction"))


@query(
    "m8_fit_report",
    sql(f"""select case when {bucket(100, 'term', 'subj', 'crse')} < 80 then 'train' else 'validation' end as part,
        count(*) as n_rows, round(avg((act_enrollment - exact) ** 2), 6) as mse,
        round(sqrt(avg((act_enrollment - exact) ** 2)), 6) as rmse, round(avg(abs(act_enrollment - exact)), 6) as mae,
        round(1 - avg((act_enrollment - exact) ** 2) / var_pop(act_enrollment), 6) as r2,
        round(avg(case when act_enrollment > 0 then abs(act_enrollment - exact) / act_enrollment end) * 100, 6) as mape
        from predicted group by part""", "features", **_CODING, **ridge([1.0])),
)
def m8(spark, sf):
    report = M.fit_report(standin.features(spark, sf), _ridge(spark, sf))
    return report.withColumns(_r6("mse", "rmse", "mae", "r2", "mape"))


_NAMES = "(values ('term'), ('subj'), ('crse'), ('credits')) as t(feature)"


@query("m7_forest_predictions")
def m7_predictions(spark, sf):
    """What a searched forest predicts for each validation row, and its error."""
    scored = M.predict(standin.features(spark, sf).filter(~FT.in_training()), _forest(spark, sf))
    return scored.select("term", "subj", "crse", TARGET, "prediction", F.abs(F.col(TARGET) - F.col("prediction")).alias("error"))


@query("m7_forest_search")
def m7_search(spark, sf):
    """The error of every grid point: depths and minimum split sizes from the same grown forests."""
    return M.search_report(spark, _forest(spark, sf))


@query("m9_feature_importance")
def m9(spark, sf):
    """The importances of a searched forest, strongest first."""
    return M.feature_importance(spark, _forest(spark, sf))


@query(
    "m9_importance_properties",
    sql(f"select feature, true as sums_to_one, true as descending from {_NAMES}"),
)
def m9_properties(spark, sf):
    """A searched forest's importances: one per feature, together 1, strongest first."""
    found = M.feature_importance(spark, _forest(spark, sf)).collect()
    values = [r.importance for r in found]
    one, order = abs(sum(values) - 1) < 1e-9, values == sorted(values, reverse=True)
    return spark.createDataFrame([(r.feature, one, order) for r in found], "feature string, sums_to_one boolean, descending boolean")


@query(
    "m9_single_split",
    sql(f"select t.feature, case when t.feature = best.feature then 1.0::double else 0.0::double end as importance from {_NAMES}, best",
        "features", **_CODING, **_SPLITS),
)
def m9_single_split(spark, sf):
    return M.feature_importance(spark, _stump(spark, sf))


@query("w10_top_features")
def w10(spark, sf):
    """The five strongest features of a searched forest."""
    return M.feature_importance(spark, _forest(spark, sf), top=5)


@query(
    "w10_single_split",
    sql("select feature, 1.0::double as importance from best", "features", **_CODING, **_SPLITS),
)
def w10_single_split(spark, sf):
    return M.feature_importance(spark, _stump(spark, sf), top=1)


_PREDICTED = "select term, subj, crse, act_enrollment, credits, prediction from predicted"
_SCORE_INPUT = """
select term, subj, crse, cast(sum(act) as bigint) as act, avg(credits) as credits from sections
where term = 199940 group by term, subj, crse having sum(act) >= 10"""


@query("m10_saved_model", sql(_PREDICTED, "features", **_CODING, **ridge([1.0])))
def m10(spark, sf):
    path = scratch_path(spark, "m10")
    M.save_model(spark, _ridge(spark, sf), path)
    loaded = M.load_model(spark, path)
    return M.predict(standin.features(spark, sf), loaded).withColumns(_r6("prediction"))


@query("m11_batch_score", sql(_PREDICTED, "features", **coding("features", "all_features"), **ridge([1.0])))
def m11(spark, sf):
    return scoring.score(standin.sections(spark, sf), _ridge(spark, sf)).withColumns(_r6("prediction"))


_YS = ("year", "semester", "subject_subj", "course")
_YS_SQL = """select *, term // 100 as year, term as semester, subj as subject_subj, crse as course from {t}"""


@query(
    "m11_score_year_semester",
    sql("select year, semester, subj as \"Subject_Subj\", crse as \"Course\", prediction from predicted",
        "features", ys=_YS_SQL.format(t="features"), ys_all=_YS_SQL.format(t="all_features"),
        **coding("ys", "ys_all", _YS), **ridge([1.0], _YS)),
)
def m11_year_semester(spark, sf):
    """Tables with year and semester, and other names for subject and course, from training to scores."""
    rows = standin.sections(spark, sf).withColumnsRenamed({"subj": "Subject_Subj", "crse": "Course"})
    rows = rows.select(TM.term_year(F.col("term")).alias("year"), F.col("term").alias("semester"), "Subject_Subj", "Course", "act", "credits")
    fitted = M.fit(A.course_term(rows.filter(F.col("semester") >= FLOOR)), "linear", grid={"alpha": (1.0,)})
    out = scoring.score(rows, fitted).select("year", "semester", "Subject_Subj", "Course", "prediction")
    return out.withColumns(_r6("prediction"))


@query(
    "m12_score_query",
    sql("select term, subj, crse, act, credits, prediction, "
        "row_number() over (order by term, subj, crse) - 1 as index from predicted",
        "features", asked=_SCORE_INPUT, **coding("features", "asked"), **ridge([1.0])),
)
def m12(spark, sf):
    text = """
        select term, subj, crse, sum(act) as act, avg(credits) as credits from {s}
        where term = :term group by term, subj, crse having sum(act) >= 10"""
    out = scoring.score_query(spark, text, _ridge(spark, sf), {"term": 199940}, s=standin.sections(spark, sf))
    return out.withColumns(_r6("prediction"))


_CHOSEN = """
select term, subj, crse, cast(sum(act) as bigint) as act_enrollment, max(credits) as credits from sections
where term in (199840, 199910, 199940, 200010) and act > 10 group by term, subj, crse"""


@query(
    "m13_train_on_terms",
    sql("""select ['intercept', 'term', 'subj', 'crse', 'credits'][i + 1] as feature, round(w, 6) as weight,
        'enrollment_tree_min_linear_spring_1998_to_fall_2000' as model_name from weights where fold = -1
          and alpha = (select alpha from fold_mse group by alpha order by avg(mse) limit 1)""",
        "sections", chosen=_CHOSEN, **coding("chosen", "chosen"), **ridge([0.1, 1.0, 10.0, 100.0, 1000.0])),
)
def m13(spark, sf):
    fitted = training.train(spark, standin.sections(spark, sf), _TERMS, "linear")
    weights = M.coefficients(spark, fitted).withColumns(_r6("weight"))
    return weights.withColumn("model_name", F.lit(fitted.info["name"]))


@query(
    "m14_score_subject_term",
    sql(f"{_PREDICTED} where subj = 'MEDIUM' and term = 199940", "features", **_CODING, **ridge([1.0])),
)
def m14(spark, sf):
    out = scoring.score_subject_term(standin.sections(spark, sf), _ridge(spark, sf), "MEDIUM", 199940)
    return out.withColumns(_r6("prediction"))


@query(
    "m11_score_course",
    sql("""select term, subj, crse, credits, prediction, cast(total as bigint) as total_act,
        round(abs(exact - total), 6) as error, round(abs(exact - total) / total * 100, 6) as error_pct
        from predicted left join
          (select sum(act) as total from sections where subj = 'PROMO' and crse = 210 and term = 199940) on true""",
        "features",
        asked="select 199940 as term, 'PROMO' as subj, 210 as crse, coalesce(nullif(max(credits), 0), 3) as credits from sections "
              "where subj = 'PROMO' and crse = 210",
        **coding("features", "asked"), **ridge([1.0])),
)
def m11_course(spark, sf):
    out = scoring.score_course(spark, standin.sections(spark, sf), _ridge(spark, sf), "PROMO", 210, 199940)
    return out.withColumns(_r6("prediction", "error", "error_pct"))


# --- history features -------------------------------------------------------------------------


@query("x1_course_mean", sql("select term, subj, crse, course_mean from history", "history"))
def x1(spark, sf):
    return H.with_history_features(standin.all_features(spark, sf)).select("term", "subj", "crse", "course_mean")


@query("x2_last_term", sql("select term, subj, crse, last_term from history", "history"))
def x2(spark, sf):
    return H.with_history_features(standin.all_features(spark, sf)).select("term", "subj", "crse", "last_term")


@query("x3_two_term_trend", sql("select term, subj, crse, trend from history", "history"))
def x3(spark, sf):
    return H.with_history_features(standin.all_features(spark, sf)).select("term", "subj", "crse", "trend")


@query(
    "x4_term_parts",
    sql("""select *, term // 100 as academic_year, term // 100 - (term % 100 = 10)::int as calendar_year,
        term % 100 as semester_code, case term % 100 when 10 then 'fall' else 'spring' end as season,
        (term % 100 = 10)::int as is_fall, (term % 100 = 40)::int as is_spring from features""", "features"),
)
def x4(spark, sf):
    return H.with_term_parts(standin.features(spark, sf))


@query(
    "x5_class_size_bucket",
    sql("""select term, crn, case when act < 15 then 0 when act < 30 then 1 when act < 60 then 2 when act < 120 then 3
        else 4 end as size_bucket from sections""", "sections"),
)
def x5(spark, sf):
    return standin.sections(spark, sf).select("term", "crn", H.class_size_bucket(F.col("act")).alias("size_bucket"))


@query(
    "x6_course_folds",
    sql(f"select term, subj, crse, cast({bucket(5, 'subj', 'crse', seed='fold')} as integer) as fold from features",
        "features"),
)
def x6(spark, sf):
    return standin.features(spark, sf).select("term", "subj", "crse", H.course_fold(5).alias("fold"))


@query(
    "x7_unseen_minus_one",
    sql("select f.term, f.subj, f.crse, cast(coalesce(s.code, -1) as double) as subj_code from features f "
        "left join subjects s on f.subj = s.subj", "features",
        subjects="select subj, row_number() over (order by subj) - 1 as code from "
                 "(select distinct subj from features where subj <> 'SMALL')"),
)
def x7(spark, sf):
    data = standin.features(spark, sf)
    encoding = FT.fit_encoding(data.filter("subj <> 'SMALL'"), FT.min_features(data), unseen="minus_one")
    return encoding.transform(data).select("term", "subj", "crse", "subj_code")


@query(
    "x8_median_mape_without_smallest",
    sql("""select count(*) as courses, round(median(mape), 6) as median_mape from accuracy
        where avg_enrollment >= (select quantile_cont(avg_enrollment, 0.05) from accuracy)""", "accuracy"),
)
def x8(spark, sf):
    return ACC.median_mape_without_smallest(_accuracy(spark, sf)).withColumns(_r6("median_mape"))


@query(
    "x9_lagged_totals",
    sql("""select f.*, cast(p.lagged as bigint) as lagged_program, cast(u.lagged as bigint) as lagged_university
        from features f
        join (select subj, term, lag(sum(act_enrollment)) over (partition by subj order by term) as lagged
              from features group by subj, term) p on f.subj = p.subj and f.term = p.term
        join (select term, lag(sum(act_enrollment)) over (order by term) as lagged from features group by term) u
          on f.term = u.term""", "features"),
)
def x9(spark, sf):
    return H.with_lagged_totals(standin.features(spark, sf))


@query(
    "x9_three_levels",
    sql("""select f.*, cast(p.lagged as bigint) as lagged_program, cast(s.lagged as bigint) as lagged_school, cast(u.lagged as bigint) as lagged_university
        from schools f
        join (select subj, term, lag(sum(act_enrollment)) over (partition by subj order by term) as lagged from schools group by subj, term) p
          on f.subj = p.subj and f.term = p.term
        join (select school, term, lag(sum(act_enrollment)) over (partition by school order by term) as lagged from schools group by school, term) s
          on f.school = s.school and f.term = s.term
        join (select term, lag(sum(act_enrollment)) over (order by term) as lagged from schools group by term) u on f.term = u.term""",
        "features", schools="select *, crse % 4 as school from features"),
)
def x9_levels(spark, sf):
    """Totals of the program, of a school column, and of everything, one term back."""
    features = standin.features(spark, sf).withColumn("school", F.col("crse") % 4)
    return H.with_lagged_totals(features, {"program": ["subj"], "school": ["school"], "university": []})


@query("c6_sample_values", sql("select distinct term_desc from sections", "sections"))
def c6_samples(spark, sf):
    """The values of a column of few different ones, by a sample at least as large."""
    return P.sample_values(standin.sections(spark, sf), "term_desc", 100)


@query(
    "x9_enrollment_trend",
    sql("""select subj, crse, round(regr_slope(total, year) filter (year > 1996), 6) as trend_5y,
        round(regr_slope(total, year) filter (year > 1991), 6) as trend_10y from
        (select subj, crse, term // 100 as year, sum(act_enrollment)::double as total from all_features
         where term // 100 between 1992 and 2001 group by all) group by subj, crse""", "all_features"),
)
def x9_trend(spark, sf):
    trend = H.enrollment_trend(standin.all_features(spark, sf), 2001)
    return trend.withColumns(_r6("trend_5y", "trend_10y"))
