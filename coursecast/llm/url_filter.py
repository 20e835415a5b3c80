"""URL filter: allow and block rules, and boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursecast.llm.shared import by_hash
from coursecast.sources.scratch import settle

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the filter.
RULES = (
    Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"),
    Rule(True, "com", "/fr/"), Rule(False, "com", "/de/"),
)

LEXICAL = (
    "length", "host_length", "labels", "depth", "longest_segment", "digit_ratio", "host_digits", "hyphens",
    "entropy", "parameters", "query_length", "suffix_rate", "suffix_seen", "tail_rate", "tail_seen",
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct of ``name`` and ``allow``; null if none fits.

    One expression per rule: rules are settings, a few hundred at most.
    """
    out = F.lit(None).cast("struct<name:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a url (with its ``host`` and ``path``) has by itself, and its suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    count = lambda text, what: F.length(text) - F.length(F.translate(text, what, ""))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    return urls.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "labels": F.when(F.col("host") == "", 0).otherwise(F.size(labels)).cast("double"),
        "depth": F.size(segments).cast("double"),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)).cast("double"),
        "digit_ratio": count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": count(F.col("host"), "0123456789").cast("double"),
        "hyphens": count(F.col("host"), "-").cast("double"),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1).cast("double"),
        "query_length": F.length(query).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
        "tail": F.substring_index("host", ".", -2),
    })


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame], prior: float, own: Column | None = None) -> DataFrame:
    """Share of blocked urls per suffix in the training data, drawn towards the overall share.

    ``own`` is the number of a training row's copies: they are taken out of the counts, so that no rate tells the row's label.
    """
    mine = F.lit(0) if own is None else own
    mine_blocked = F.lit(0) if own is None else own * F.col("label")
    for name, counts in rates.items():
        counts = counts.select(F.col(name).alias("_key"), F.col("n").alias("_n"), F.col("blocked").alias("_b"))
        rows = rows.join(counts, rows[name] == F.col("_key"), "left").withColumns({
            f"{name}_rate": (F.coalesce("_b", F.lit(0)) - mine_blocked + 2 * F.lit(prior)) / (F.coalesce("_n", F.lit(0)) - mine + 2),
            f"{name}_seen": F.log1p((F.coalesce("_n", F.lit(0)) - mine).cast("double")),
        }).drop("_key", "_n", "_b")
    return rows


@dataclass
class UrlModel:
    """Boosted trees with the suffix counts they were trained with; no trees if there was one class."""

    trees: GBTClassificationModel | None
    rates: dict[str, DataFrame]
    prior: float

    def blocked(self, rows: DataFrame) -> DataFrame:
        """``rows`` of lexical features with ``chance``, the probability of a block."""
        if self.trees is None:
            return rows.withColumn("chance", F.lit(self.prior))
        rows = VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(_with_rates(rows, self.rates, self.prior))
        rows = self.trees.transform(rows)
        return rows.withColumn("chance", vector_to_array("probability")[1])


def train(labelled: DataFrame, *, max_rows: int = 20000, rounds: int = 20, depth: int = 4, seed: int = 5) -> UrlModel:
    """Trees from ``labelled`` (``url``, ``host``, ``path``, ``label`` 1 for block), at most ``max_rows`` of its different urls.

    Suffix counts and the overall share come from all labelled rows, for a training row from all but its own copies. The trees' rows are taken by hash of the url,
    repeats left out, so that copies of one url cannot fill the sample.
    """
    tails = labelled.groupBy(F.substring_index("host", ".", -2).alias("tail"))
    tails = settle(tails.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "url-tail")
    suffixes = tails.groupBy(F.substring_index("tail", ".", -1).alias("suffix"))
    suffixes = settle(suffixes.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), "url-suffix")
    rates = {"suffix": suffixes, "tail": tails}
    n, blocked = (x or 0 for x in suffixes.agg(F.sum("n"), F.sum("blocked")).first())
    prior = blocked / n if n else 0.0
    if blocked in (0, n):
        return UrlModel(None, {}, prior)
    once = labelled.groupBy("url", "host", "path", "label").agg(F.count("*").alias("copies"))
    sample = settle(lexical(by_hash(once, ["url", "label"], max_rows)).coalesce(1), "url-sample")
    rates_of_others = _with_rates(sample, rates, prior, F.col("copies"))
    rows = VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(rates_of_others)
    rows = settle(rows.select("features", F.col("label").cast("double").alias("label")).coalesce(2), "url-features")
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed, subsamplingRate=1.0, cacheNodeIds=False)
    return UrlModel(gbt.fit(rows), rates, prior)


def url_filter(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, **training) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``chance`` of every row.

    The longest rule that fits decides. The other urls go by boosted trees trained from ``labelled`` (``url``
    and ``label``, 1 for block; other values are no label), by default from the urls that the rules judge.
    Null urls and urls without ``://`` have an empty host and path, and are judged like others. If the labels
    have one class only, that is the verdict; without labels it is allow. Repeated rows are judged each;
    ``chance`` is null where a rule decided. Other columns are ignored.
    """
    url = F.col("url").cast("string")
    judged = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        source = judged.filter("fit is not null").select("url", "host", "path", (~F.col("fit.allow")).cast("int").alias("label"))
    else:
        url = F.col("url").cast("string")
        source = labelled.filter(F.col("label").isin(0, 1)).select(
            url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("label").cast("int").alias("label")
        )
    model = train(source, **training)
    by_rule = judged.filter("fit is not null").select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"),
        F.when(F.col("fit.allow"), "allow").otherwise("block").alias("verdict"), F.lit(None).cast("double").alias("chance"),
    )
    rest = model.blocked(lexical(judged.filter("fit is null"))).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(F.col("chance") > 0.5, "block").otherwise("allow").alias("verdict"), "chance",
    )
    return by_rule.unionByName(rest)
