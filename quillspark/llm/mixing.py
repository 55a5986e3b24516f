"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the paths (domain, language, source) of a tree.  The token budget
flows down from the root in proportion to weights; a node can take no more
than its leaves can give in ``max_epochs`` passes, and what it can't take goes
to its siblings first.  Only if all siblings are full does the shortage reach
their parent's siblings, because a parent's own limit is the sum of its
leaves'.  Each leaf then gives whole epochs and a token prefix of one more
epoch, in an order seeded by epoch and document.

The prefix is found without sorting a leaf in one task: token sums by
leaf and leading digits of the order key (pre-aggregated on the map side) name
the one slice in which the prefix ends, and only that slice is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.graph import cut

LEVELS = ("domain", "language", "source")
#: Leaf plans up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered_domain(source: Column, domains: int = 4) -> Column:
    """Domain of a source named with a trailing number; other names are ``other``."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(n.try_cast("int"), F.lit(domains)).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """Weight of a node by its name, 1 where none is given."""
    given = weights.get(level, {})
    out = F.lit(1).cast("bigint")
    for name, w in sorted(given.items()):
        out = F.when(F.col(level) == name, F.lit(w).cast("bigint")).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Allocation of each child, given ``granted`` of its parent: proportional, limited by ``cap``.

    Children that are full at the level of the others (in order of cap per
    weight) get their cap; the rest is divided among the others by weight.
    """
    nodes = nodes.withColumn("w", _weight(level, weights)).where("w > 0")
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
    nodes = (
        nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(order), F.lit(0)))
        .withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("granted") - F.col("cap_before")))
        .withColumn("rest", F.col("granted") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
        .withColumn("w_rest", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by))
    )
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * rest) div nullif(w_rest, 0)"))
    return nodes.withColumn("granted", given).drop("w", "cap_before", "w_left", "full", "rest", "w_rest")


def leaf_quotas(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int, max_epochs: int = 1) -> DataFrame:
    """``domain``, ``language``, ``source``, ``tokens``, ``quota`` of each leaf.

    ``leaves`` has the token sum of each leaf.  Quotas are whole tokens, so
    they can fall short of the budget by less than one token a node.  Nodes of
    weight 0 or less get nothing and are left out.
    """
    top = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    domains = top.groupBy("domain").agg(F.sum("cap").alias("cap"))
    whole = domains.withColumn("granted", F.lit(budget).cast("bigint")).withColumn("root", F.lit(0))
    whole = _share(whole, ["root"], "domain", weights).select("domain", "granted")
    languages = top.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(whole, "domain")
    languages = _share(languages, ["domain"], "language", weights).select("domain", "language", "granted")
    sources = _share(top.join(languages, ["domain", "language"]), ["domain", "language"], "source", weights)
    return sources.select(*LEVELS, "tokens", F.col("granted").alias("quota"))


def _key(id: str | Column, epoch: str | Column, seed: int) -> Column:
    id = F.col(id) if isinstance(id, str) else id
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(epoch).cast("string"), F.lit(":"), F.coalesce(id.cast("string"), F.lit(""))))


def leaf_plan(docs: DataFrame, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int = 1, seed: int = 42) -> DataFrame:
    """What each leaf gives: ``epochs`` whole passes, then rows of one more with key up to ``last_key``.

    ``docs``: ``id``, the three levels (not null) and ``n_tokens``.  The budget
    is ``budget_share`` of all tokens.
    """
    leaves = cut(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    quota = leaf_quotas(leaves, weights, int(total * budget_share), max_epochs)
    plan = cut(quota.withColumn("epochs", F.coalesce(F.expr("quota div nullif(tokens, 0)"), F.lit(0))).withColumn("part", F.col("quota") - F.col("epochs") * F.col("tokens")))
    keyed = _with_plan(docs, plan).withColumn("key", _key("id", "epochs", seed)).withColumn("slice", F.substring("key", 1, 3))
    slices = keyed.groupBy(*LEVELS, "slice", "part").agg(F.sum("n_tokens").alias("slice_tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice")
    ends = slices.withColumn("sum", F.sum("slice_tokens").over(upto)).where("sum > part")
    ends = ends.groupBy(*LEVELS).agg(F.min("slice").alias("slice"), F.min("sum").alias("sum"))
    ends = ends.join(slices.select(*LEVELS, "slice", "slice_tokens"), [*LEVELS, "slice"]).select(*LEVELS, "slice", (F.col("sum") - F.col("slice_tokens")).alias("before"))
    ends = cut(ends)
    inside = _with_plan(keyed.select(*LEVELS, "slice", "key", "id", "n_tokens", "part"), ends, [*LEVELS, "slice"])
    order = Window.partitionBy(*LEVELS).orderBy("key")
    fits = inside.withColumn("sum", F.col("before") + F.sum("n_tokens").over(order)).where("sum <= part")
    last = fits.groupBy(*LEVELS).agg(F.max("key").alias("key"))
    # no row of the slice fits: its leading digits sort below all its keys and above all earlier ones
    named = ends.select(*LEVELS, "slice").join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("key", "slice").alias("last_key"))
    return cut(plan.join(named, list(LEVELS), "left").select(*LEVELS, "tokens", "quota", "epochs", F.coalesce("last_key", F.lit("g")).alias("last_key")))


def _with_plan(docs: DataFrame, plan: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Join a plan by leaf: broadcast where its counted size allows, else by shuffle."""
    small = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return docs.join(F.broadcast(plan) if small else plan, on or list(LEVELS))


def mixed_copies(docs: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` (``id`` and levels) with ``copies``, the number of epochs that hold the row; rows in none go."""
    rows = _with_plan(docs, plan)
    extra = (_key("id", "epochs", seed) <= F.col("last_key")).cast("bigint")
    return rows.withColumn("copies", F.col("epochs") + F.when((F.col("quota") > F.col("epochs") * F.col("tokens")), extra).otherwise(0)).where("copies > 0")


def leaves_of(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> list[Column]:
    """Columns ``id`` and the three levels; a null language or source is the empty name."""
    return [F.col(id).alias("id"), numbered_domain(F.col(source)).alias("domain"), F.coalesce(F.col(lang), F.lit("")).alias("language"), F.coalesce(F.col(source), F.lit("")).alias("source")]


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int = 1, seed: int = 42, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per selected row of ``docs``: ``id``, levels, ``n_tokens``, ``quota``, ``copies``.

    Rows with the same id share their place in an epoch and are selected
    together.  Null texts have no tokens, a leaf without any token has no
    share and gives no rows.  Empty tables give no rows.
    """
    narrow = cut(docs.select(*leaves_of(docs, id, text, lang, source), word_tokens(F.col(text)).alias("n_tokens")))
    plan = leaf_plan(narrow, weights, budget_share, max_epochs, seed)
    return mixed_copies(narrow, plan, seed).select(F.col("id").alias(id), *LEVELS, "n_tokens", "quota", "copies")


def mix_documents(docs: DataFrame, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int = 1, seed: int = 42) -> DataFrame:
    """The selected rows of ``docs``, all its columns, each as often as its copies say.

    The decision is local to a row once the leaf plan is known, so the texts
    are not shuffled.
    """
    narrow = cut(docs.select(*leaves_of(docs), word_tokens(F.col("text")).alias("n_tokens")))
    plan = leaf_plan(narrow, weights, budget_share, max_epochs, seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *leaves_of(docs))
    chosen = mixed_copies(packed, plan, seed)
    if max_epochs > 1:
        chosen = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return chosen.select("row.*")


def mix_sql(weights: dict[str, dict[str, int]], budget_share: str, max_epochs: int, seed: int) -> str:
    """DuckDB SQL for the rows of :func:`mix` on ``documents``."""

    def weight(level: str) -> str:
        cases = " ".join(f"when {level} = '{n}' then {w}" for n, w in sorted(weights.get(level, {}).items()))
        return f"case {cases} else 1 end" if cases else "1"

    def share(source: str, parent: str, level: str, keep: str) -> str:
        by = f"partition by {parent}"
        before = f"({by} order by cap::double / w, {level} rows between unbounded preceding and 1 preceding)"
        return f"""
        (select {keep}, case when is_full then cap else (w * rest) // nullif(w_rest, 0) end as granted from
          (select *, granted - sum(case when is_full then cap else 0 end) over ({by}) as rest,
                  sum(case when is_full then 0 else w end) over ({by}) as w_rest from
            (select *, cap * w_left <= w * (granted - cap_before) as is_full from
              (select *, coalesce(sum(cap) over {before}, 0) as cap_before,
                      sum(w) over ({by}) - coalesce(sum(w) over {before}, 0) as w_left from
                (select *, {weight(level)} as w from {source}) where w > 0))))"""

    n = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    return f"""
    with docs as (
      select doc_id, case when {n} = '' then 'other' else 'domain' || (cast(nullif({n}, '') as int) % 4) end as domain,
             coalesce(lang, '') as language, coalesce(source, '') as source,
             coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens
      from documents),
    leaves as (select domain, language, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {max_epochs})::bigint as cap from docs group by all),
    top as (select domain, sum(cap) as cap, 0 as root, (select floor(sum(tokens) * {budget_share}::double)::bigint from leaves) as granted from leaves group by domain),
    domains as (select * from {share("top", "root", "domain", "domain")}),
    mid as (select l.domain, l.language, sum(l.cap) as cap, any_value(d.granted) as granted from leaves l join domains d using (domain) group by all),
    languages as (select * from {share("mid", "domain", "language", "domain, language")}),
    low as (select l.*, g.granted from leaves l join languages g using (domain, language)),
    quotas as (select * from {share("low", "domain, language", "source", "domain, language, source, tokens")}),
    plan as (select *, coalesce(granted // nullif(tokens, 0), 0) as epochs from quotas),
    keyed as (
      select d.*, p.granted as quota, p.epochs, p.granted - p.epochs * p.tokens as part,
             md5('{seed}:' || p.epochs::bigint || ':' || d.doc_id) as k
      from docs d join plan p using (domain, language, source)),
    summed as (select *, sum(n_tokens) over (partition by domain, language, source order by k) as upto from keyed)
    select doc_id, domain, language, source, n_tokens, quota::bigint as quota, (epochs + case when part > 0 and upto <= part then 1 else 0 end)::bigint as copies
    from summed where epochs + case when part > 0 and upto <= part then 1 else 0 end > 0"""
