"""Mixing sources to target weights: budgets go down a domain - language - source tree.

Each node deals its budget to its children by integer weights, but no child gets more than its
leaves can supply; what a child cannot take goes to its siblings, in proportion to their weights.
Only a node that is short as a whole leaves tokens to the siblings of its parent, and so on up.
A leaf supplies its tokens once per epoch. Its budget is the first tokens of its stream: whole
epochs, then the leading rows of one more epoch in a seeded order, the last row cut to fit.

Only sums per leaf, and per leaf and hash bucket, are ordered in one place; the rows of the one
bucket in which a budget ends are the only rows that are sorted, so a leaf with a third of all
rows is no larger task than others. All steps are DataFrame functions.

Null languages and sources count as ''. Rows without text hold no tokens. Rows of equal id have
equal places in every order: they are taken together, so such rows may pass a budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.llm import common

LEVELS = ("__domain", "__lang", "__source")
SEED = 7
EPOCHS = 2
PERCENT = 60
#: Hexadecimal digits of the order's hash that make a bucket: 4,096 buckets a leaf and epoch.
BUCKET_DIGITS = 3
#: Integer weights by name; names that are not listed weigh 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}


def domain_of(source: Column) -> Column:
    """Production rule: a source's last number modulo 4 names its domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), number.cast("int") % 4)).otherwise("other")


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a token for every four bytes begun."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _weight(weights: Mapping[str, int], name: str) -> Column:
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    if not weights:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(name)), F.lit(1))


def _in_tree(docs: DataFrame) -> DataFrame:
    """The rows with their place in the tree and their tokens, under names of our own."""
    return docs.withColumns({
        "__domain": domain_of(F.col("source")), "__lang": F.coalesce("lang", F.lit("")),
        "__source": F.coalesce("source", F.lit("")), "__tokens": tokens_of(F.col("text")),
        "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})


def _deal(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Deal ``budget`` (of the parent) to children with ``capacity`` and ``weight``: ``share``.

    Children are filled in the order of capacity by weight; the others get whole-number shares
    of the rest, and the tokens left by rounding go to the first names.
    """
    p = W.partitionBy(*parents)
    by_need = p.orderBy(F.col("capacity") / F.col("weight"), name)
    big = "decimal(19,0)"
    filled = nodes.withColumns({
        "before": F.coalesce(F.sum("capacity").over(
            by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))})
    filled = filled.withColumn("full", F.col("capacity").cast(big) * F.col("rest").cast(big)
                               <= (F.col("budget") - F.col("before")).cast(big)
                               * F.col("weight").cast(big))
    filled = filled.withColumn("full", F.min("full").over(
        by_need.rowsBetween(W.unboundedPreceding, 0)))
    shared = filled.withColumns({
        "left": F.col("budget") - F.coalesce(
            F.sum(F.when(F.col("full"), F.col("capacity"))).over(p), F.lit(0)),
        "parts": F.sum(F.when(~F.col("full"), F.col("weight"))).over(p)})
    shared = shared.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(
        F.expr(f"CAST(left AS {big}) * CAST(weight AS {big}) div parts")))
    over = F.col("left") - F.sum(F.when(~F.col("full"), F.col("share"))).over(p)
    turn = F.sum(F.when(~F.col("full"), 1)).over(
        p.orderBy(name).rowsBetween(W.unboundedPreceding, 0))
    shared = shared.withColumns({"over": over, "turn": turn})
    share = F.col("share") + F.when(~F.col("full") & (F.col("turn") <= F.col("over")), 1).otherwise(0)
    return shared.withColumn("share", share).drop(
        "before", "rest", "full", "left", "parts", "over", "turn")


def leaf_budgets(leaves: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS,
                 weights: tuple[Mapping[str, int], ...] = (
                     DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """``budget`` of each leaf. ``leaves`` has the three names and ``length`` (tokens).

    The whole budget is ``percent`` of all tokens; a leaf supplies up to ``epochs`` times its own.
    """
    if percent < 0 or percent > 100 * epochs:
        raise ValueError("the budget must lie within what all epochs supply")
    nodes = leaves.withColumn("root", F.lit(0))
    budget = None
    for depth, name in enumerate(LEVELS):
        parents = ["root", *LEVELS[:depth]]
        level = nodes.groupBy(*parents, name).agg(
            F.sum(F.col("length") * epochs).alias("capacity"), F.sum("length").alias("length"))
        if budget is None:
            whole = F.sum("length").over(W.partitionBy("root"))
            level = level.withColumn("whole", whole).withColumn(
                "budget", F.expr(f"whole * {percent} div 100")).drop("whole")
        else:
            level = level.join(budget, parents)
        level = level.withColumn("weight", _weight(weights[depth], name))
        budget = _deal(level, parents, name).select(
            *parents, name, F.col("share").alias("budget"))
    return budget.drop("root")


def cuts(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED,
         weights: tuple[Mapping[str, int], ...] = (
             DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """For each leaf: whole epochs, and where the part of one more epoch ends.

    ``whole`` epochs are taken; of epoch ``whole`` the rows up to ``last`` in the seeded order,
    rows at ``last`` with ``room`` tokens at most. ``last`` is null when no part is taken.
    """
    slim = _in_tree(docs).select(*LEVELS, "__tokens", "__id")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("__tokens").alias("length"))
    leaves = common.staged(leaves, "leaves")
    budgets = leaf_budgets(leaves, percent, epochs, weights).join(leaves, list(LEVELS))
    plan = budgets.select(
        *LEVELS, F.expr("CASE WHEN length > 0 THEN budget div length ELSE 0 END").alias("whole"),
        F.expr("CASE WHEN length > 0 THEN budget % length ELSE 0 END").alias("part"))
    plan = common.staged(plan, "leaf-plan")

    partly = slim.join(plan.filter("part > 0"), list(LEVELS)).withColumn(
        "__place", _place(F.col("whole"), seed))
    partly = partly.withColumn("__bucket", F.substring("__place", 1, BUCKET_DIGITS))
    sums = partly.groupBy(*LEVELS, "part", "__bucket").agg(F.sum("__tokens").alias("sum"))
    upto = F.sum("sum").over(W.partitionBy(*LEVELS).orderBy("__bucket").rowsBetween(
        W.unboundedPreceding, 0))
    ending = sums.withColumn("upto", upto).filter("upto >= part AND upto - sum < part").select(
        *LEVELS, "__bucket", (F.col("upto") - F.col("sum")).alias("before"))
    ending = common.staged(ending, "last-buckets")

    rows = partly.join(ending, [*LEVELS, "__bucket"])
    same = F.sum("__tokens").over(W.partitionBy(*LEVELS, "__place"))
    seen = F.sum("__tokens").over(W.partitionBy(*LEVELS).orderBy("__place").rangeBetween(
        W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("start", F.col("before") + seen - same).filter("start < part")
    last = rows.groupBy(*LEVELS).agg(
        F.max("__place").alias("last"), (F.max("part") - F.max("start")).alias("room"))
    return common.staged(plan.join(last, list(LEVELS), "left"), "cuts")


def _place(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), "__id"))


def selected(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED,
             weights: tuple[Mapping[str, int], ...] = (
                 DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """The rows of ``docs`` that are taken, once per epoch, with ``__epoch`` and ``__taken``.

    All columns of ``docs`` stay; the operator's own begin with two underscores.
    """
    ends = cuts(docs, percent, epochs, seed, weights)
    rows = _in_tree(docs).join(ends, list(LEVELS))
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    rows = rows.withColumn("__place", _place(F.col("__epoch"), seed))
    rows = rows.filter("__epoch < whole OR __place <= last")
    return rows.withColumn("__taken", F.when(
        (F.col("__epoch") == F.col("whole")) & (F.col("__place") == F.col("last")),
        F.least("__tokens", "room")).otherwise(F.col("__tokens")))


def digests(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "lang", "source", "text")
    return selected(slim).select(
        "doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"),
        F.col("__source").alias("source"), F.col("__epoch").alias("epoch"),
        F.col("__tokens").alias("tokens"), F.col("__taken").alias("taken"))


def sql() -> str:
    """DuckDB SQL for the rows of ``digests``: plain windows over whole leaves."""
    def weight(weights: Mapping[str, int], name: str) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
        return f"CASE {name} {whens} ELSE 1 END" if whens else "1"

    ctes, parents = [f"""
docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]$')
         THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4)
         ELSE 'other' END AS domain,
    coalesce((strlen(text) + 3) // 4, 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(tokens)::HUGEINT AS len
    FROM docs GROUP BY ALL),
n0 AS (SELECT root, sum(len) * {PERCENT} // 100 AS share FROM leaves GROUP BY ALL)"""], ["root"]
    for i, (name, weights) in enumerate(zip(
            ("domain", "lang", "source"), (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)), 1):
        up, need = ", ".join(parents), f"ORDER BY cap::DOUBLE / w, {name}"
        ctes.append(f"""
c{i} AS (SELECT {up}, {name}, sum(len) * {EPOCHS} AS cap,
    ({weight(weights, name)})::HUGEINT AS w FROM leaves GROUP BY ALL),
a{i} AS (SELECT c.*, n.share AS b,
    coalesce(sum(cap) OVER (PARTITION BY {up} {need}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (PARTITION BY {up} {need}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM c{i} c JOIN n{i - 1} n USING ({up})),
f{i} AS (SELECT *, bool_and(cap * rest <= (b - before) * w) OVER (PARTITION BY {up} {need}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_ FROM a{i}),
s{i} AS (SELECT *, CASE WHEN full_ THEN cap ELSE
        (b - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY {up}), 0)) * w
        // sum(w) FILTER (NOT full_) OVER (PARTITION BY {up}) END AS given FROM f{i}),
n{i} AS (SELECT {up}, {name}, (given + CASE WHEN NOT full_ AND
        count(*) FILTER (NOT full_) OVER (PARTITION BY {up} ORDER BY {name}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        <= b - sum(given) OVER (PARTITION BY {up}) THEN 1 ELSE 0 END)::HUGEINT AS share
    FROM s{i})""")
        parents.append(name)
    ctes.append(f"""
epochs AS (SELECT d.*, e.epoch, n.share, l.len,
    md5('{SEED}:' || e.epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS place
    FROM docs d JOIN n3 n USING (domain, lang, source) JOIN leaves l USING (domain, lang, source),
    (SELECT unnest(range({EPOCHS + 1})) AS epoch) e WHERE e.epoch * l.len <= n.share),
placed AS (SELECT *, epoch * len + sum(tokens) OVER (
        PARTITION BY domain, lang, source, epoch ORDER BY place
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, epoch, place) AS start FROM epochs)""")
    return "WITH " + ",".join(ctes) + """
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, tokens,
    least(tokens, share - start)::BIGINT AS taken
FROM placed WHERE start < share"""
