"""SQL of the derived tables, for an independent engine to check the queries with."""

from __future__ import annotations

_TERM = (
    "cast(case when month({d}) <= 6 then year({d}) * 100 + 40 "
    "else (year({d}) + 1) * 100 + 10 end as integer)"
)

_ORDERS = f"""
    select {_TERM.format(d='o_orderdate')} as term, o_orderpriority as priority,
           cast(o_totalprice as decimal(18, 2)) as price
    from orders
"""

FLOOR = 199800

PARTS = {
    "sections": f"""
    select {_TERM.format(d='l_shipdate')} as term,
           case when month(l_shipdate) <= 6 then 'Spring ' else 'Fall ' end
             || cast(year(l_shipdate) as varchar) as term_desc,
           l_orderkey * 10 + l_linenumber as crn, p_type as subj, p_size + 200 as crse,
           cast(l_linenumber as varchar) as sec, p_size % 4 + 1 as credits, p_name as title,
           cast(l_quantity as integer) as act,
           case when l_returnflag = 'R' then l_quantity end as xl_act
    from lineitem join part on l_partkey = p_partkey""",
    "order_terms": _ORDERS,
    "term_context": """
    select term, count(*) as n_orders, cast(sum(price) as double) as revenue
    from order_terms group by term""",
    "year_context": """
    select cast(floor(term / 100) as integer) as year, term % 100 as semester, count(*) as n_orders,
           cast(sum(price) as double) as revenue
    from order_terms group by 1, 2""",
    "repeated_context": """
    select term, priority, count(*) as n_orders, cast(sum(price) as double) as revenue
    from order_terms group by term, priority""",
    "all_features": """
    select term, subj, crse, cast(sum(act) as bigint) as act_enrollment, max(credits) as credits
    from sections group by term, subj, crse""",
    "features": f"select * from all_features where term >= {FLOOR}",
    "history": """
    select *, avg(act_enrollment) over (partition by subj, crse order by term
                rows between unbounded preceding and 1 preceding) as course_mean,
           lag(act_enrollment, 1) over (partition by subj, crse order by term) as last_term,
           lag(act_enrollment, 1) over (partition by subj, crse order by term)
             - lag(act_enrollment, 2) over (partition by subj, crse order by term) as trend
    from all_features""",
    "scored": """
    select term, subj, crse, credits, act_enrollment as actual, course_mean as prediction
    from history where course_mean is not null""",
    "rated": """
    select *, abs(actual - prediction) as abs_error,
           case when actual > 0 then abs(actual - prediction) / actual * 100 end as pct_error
    from scored""",
    "rounded": """
    select subj, crse, round_even(avg(actual) * 100, 0) / 100 as avg_enrollment,
           count(actual) as predictions_count,
           round_even(stddev_samp(actual) * 100, 0) / 100 as std_enrollment,
           round_even(avg(abs_error) * 100, 0) / 100 as mae,
           round_even(avg(pct_error) * 100, 0) / 100 as mape
    from rated group by subj, crse""",
    "accuracy": """
    select subj, crse, avg_enrollment, predictions_count, std_enrollment,
           round_even(coalesce(std_enrollment / nullif(avg_enrollment, 0) * 100, 0) * 10, 0) / 10
             as variability, mae, mape
    from rounded""",
    "ranked": """
    select row_number() over (order by mape asc nulls last, subj, crse) as place, *
    from accuracy""",
    "report": """
    select term as "Term", subj as "Subject", crse as "Course", credits as "Credits",
           cast(round_even(prediction, 0) as bigint) as "Predicted_Enrollment",
           actual as "Actual_Enrollment"
    from scored""",
}

# Which derived tables each one is built on.
NEEDS = {
    "term_context": ["order_terms"],
    "year_context": ["order_terms"],
    "repeated_context": ["order_terms"],
    "all_features": ["sections"],
    "features": ["all_features"],
    "history": ["all_features"],
    "scored": ["history"],
    "rated": ["scored"],
    "rounded": ["rated"],
    "accuracy": ["rounded"],
    "ranked": ["accuracy"],
    "report": ["scored"],
}


def sql(body: str, *tables: str, **more: str) -> str:
    """``body`` with the derived tables it names, in dependency order, as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in NEEDS.get(name, []):
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in tables:
        add(name)
    ctes = [(n, PARTS[n]) for n in ordered] + list(more.items())
    head = ",\n".join(f"{n} as ({text})" for n, text in ctes)
    return f"with {head}\n{body.strip()}" if ctes else body.strip()


def bucket(n: int, *columns: str, seed: str = "") -> str:
    parts = ", ".join([*([f"'{seed}'"] if seed else []), *columns])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::bigint % {n})"


# --- ridge regression in SQL ---------------------------------------------------------------------

_FEATURES = {"term": "term", "subj": "subj_code", "crse": "crse_code", "credits": "credits"}


KEY = ("term", "subj", "crse")


def coding(base: str, apply_to: str, key: tuple[str, ...] = KEY) -> dict[str, str]:
    """CTEs that encode and scale ``apply_to`` by the training part of ``base``: train .. scaled."""
    codes = (
        "row_number() over (order by cast({c} as varchar)) - 1 as code from (select distinct {c} from train)"
    )
    coded = """
    select f.*, coalesce(s.code, 0) as subj_code, coalesce(c.code, 0) as crse_code
    from {t} f left join subjects s on f.subj = s.subj left join numbers c on f.crse = c.crse"""
    moments = ", ".join(f"avg({v}) as m_{c}, stddev_pop({v}) as s_{c}" for c, v in _FEATURES.items())
    scaled = ", ".join(
        f"(d.{v} - m.m_{c}) / coalesce(nullif(m.s_{c}, 0), 1) as {c}_scaled" for c, v in _FEATURES.items()
    )
    return {
        "train": f"select * from {base} where {bucket(100, *key)} < 80",
        "subjects": f"select subj, {codes.format(c='subj')}",
        "numbers": f"select crse, {codes.format(c='crse')}",
        "coded_train": coded.format(t="train"),
        "moments": f"select {moments} from coded_train",
        "scaled_train": f"select d.*, {scaled} from coded_train d, moments m",
        "scaled": f"select d.*, {scaled} from ({coded.format(t=apply_to)}) d, moments m",
    }


def ridge(alphas: list[float], key: tuple[str, ...] = KEY) -> dict[str, str]:
    """CTEs that solve ridge regression on scaled_train for each penalty, in and out of 5 folds.

    Column 0 is the intercept, 1 to 4 the features, 5 the label; fold -1 stands for all rows.
    Gauss-Jordan elimination, one step per column, leaves the weights in column 5.
    """
    names = list(_FEATURES)
    cells = ", ".join(["1.0", *[f"{c}_scaled" for c in names], "act_enrollment"])
    fold = bucket(5, *key, seed="fold")
    ctes = {
        "wide": f"select row_number() over () as rid, {fold} as fold, [{cells}]::double[] as v from scaled_train",
        "cells": "select rid, fold, unnest(range(6)) as i, unnest(v) as v from wide",
        "gram": """select a.fold, a.i, b.i as j, sum(a.v * b.v) as v
            from cells a join cells b on a.rid = b.rid group by all""",
        "total": "select i, j, sum(v) as v from gram group by all",
        "alphas": " union all ".join(f"select cast({a} as double) as alpha" for a in alphas),
        "step0": """select alpha, g.fold, t.i, t.j, t.v - coalesce(g.v, 0)
              + case when t.i = t.j and t.i between 1 and 4 then alpha else 0 end as v
            from total t join (select * from gram union all select -1, i, j, 0 from total) g
              on t.i = g.i and t.j = g.j cross join alphas where t.i < 5""",
    }
    for k in range(5):
        ctes[f"step{k + 1}"] = f"""
            select a.alpha, a.fold, a.i, a.j,
                   case when a.i = {k} then a.v / p.v else a.v - r.v * c.v / p.v end as v
            from step{k} a
            join step{k} p on p.alpha = a.alpha and p.fold = a.fold and p.i = {k} and p.j = {k}
            join step{k} r on r.alpha = a.alpha and r.fold = a.fold and r.i = a.i and r.j = {k}
            join step{k} c on c.alpha = a.alpha and c.fold = a.fold and c.i = {k} and c.j = a.j"""
    ctes["weights"] = "select alpha, fold, i, v as w from step5 where j = 5"
    ctes["residual"] = "select alpha, fold, i, -w as r from weights union all select distinct alpha, fold, 5, 1 from weights"
    ctes["fold_mse"] = """select x.alpha, x.fold, sum(x.r * y.r * g.v) / max(n.v) as mse
        from gram g join residual x on x.fold = g.fold and x.i = g.i
        join residual y on y.fold = g.fold and y.alpha = x.alpha and y.i = g.j
        join gram n on n.fold = g.fold and n.i = 0 and n.j = 0 group by all"""
    terms = " + ".join(f"w[{i + 2}] * {c}_scaled" for i, c in enumerate(names))
    ctes["solution"] = "select alpha, list(w order by i) as w from weights where fold = -1 group by alpha"
    ctes["predicted"] = f"select s.*, round(w[1] + {terms}, 6) as prediction, w[1] + {terms} as exact from scaled s, solution"
    return ctes
