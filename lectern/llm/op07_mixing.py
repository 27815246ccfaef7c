"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by cell (source, language, topic). The cells' weights are raked, margin after margin, until the weighted tokens
have the target shares of sources, languages and topics. A document's chance to be sampled is its cell's weight times one
factor, at most 1; the factor is calibrated so that the expected number of sampled tokens is ``rate`` of all. ``weight`` is
what a sampled document must count for where the chance was cut at 1, so that weighted margins stay on target.

Every value of a margin has its own target. Cells are pre-aggregated in each task; one row a cell reaches the driver, and the table of
chances is broadcast up to ``BROADCAST_CELLS`` cells and joined by a shuffle of rows without texts beyond. Only a caller who gives
``categories`` gets margins of so many values (the largest by tokens), the rest as ``(other)`` with their targets added up.

Targets not given are the observed shares to a power (1 keeps them, 0 makes them equal), by margin.
Nulls: a null or empty text has no tokens and the chance of its cell; a null source or language is ``(none)``; a null id is drawn
like the empty text. Repeated rows share one draw. An empty table gives an empty result. Other columns are ignored.
A target for a value without tokens is left out and the others scaled up. A value that reads ``(none)`` is one with null.
The margins are raked ``rounds`` times; with a ``tolerance`` for as long as a margin is off by more, up to ``MOST_ROUNDS`` times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.7}
ROUNDS, MOST_ROUNDS = 12, 1000
RATE = 0.6
SEED = "mix"
BROADCAST_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A plain rule for tables without a topic column: the form of the text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("***")) | F.contains(t, F.lit("!!")), "noisy")
        .when(F.char_length(t) < 400, "short")
        .when(F.char_length(t) < 4000, "article")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def draw(id_: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def off(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> float:
    """The largest difference between a share of a margin and its target."""
    return max((float(np.abs(np.bincount(code, mass, len(target)) - target).max()) for code, target in zip(codes, targets, strict=True)), default=0.0)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float | None = None) -> np.ndarray:
    """Weights of the cells (1 on average over tokens) after so many rounds over all margins, or as many as the tolerance needs."""
    mass = tokens / tokens.sum()
    for done in range(MOST_ROUNDS):
        if done >= rounds and (tolerance is None or off(mass, codes, targets) <= tolerance):
            break
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, mass, len(target))
            mass = mass * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[code]
    return np.divide(mass * tokens.sum(), tokens, out=np.zeros_like(mass), where=tokens > 0)


def factor(tokens: np.ndarray, weights: np.ndarray, rate: float) -> float:
    """The factor f for which the sum of tokens * min(1, f * weight) is rate of all tokens."""
    lo, hi = 0.0, 1.0
    goal = rate * tokens[weights > 0].sum()
    while (tokens * np.minimum(1, hi * weights)).sum() < goal * (1 - 1e-12) and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * weights)).sum() < goal else (lo, mid)
    return hi


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] = POWERS, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED, categories: int | None = None, tolerance: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, chance, weight, sampled of each row, and the columns to ``carry`` on."""
    spark = df.sparkSession
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        none(source_col).alias("source"),
        none(lang_col).alias("lang"),
        (none(topic_col) if topic_col else topic_of(F.col(text_col))).alias("topic"),
        tokens_of(F.col(text_col)).alias("n_tokens"),
        *[F.col(c).alias(f"__carry_{c}") for c in carry],
    )
    carried = [F.col(f"__carry_{c}").alias(c) for c in carry]
    rest: dict[str, float] = {}
    for m in MARGINS if categories is not None else ():
        top = rows.groupBy(m).agg(F.sum("n_tokens").alias("tokens")).orderBy(F.desc("tokens"), m).limit(categories + 1).collect()
        if len(top) > categories:
            large = {r[m] for r in top[:categories]}
            given = {x: float(v) for x, v in ((targets or {}).get(m) or {}).items() if x not in large}
            if given:
                there = rows.filter(F.col(m).isin(*given) & (F.col("n_tokens") > 0)).select(m).distinct().collect()
                rest[m] = sum(given[r[m]] for r in there)
            rows = rows.withColumn(m, F.when(F.col(m).isin(*large), F.col(m)).otherwise("(other)"))
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).orderBy(*MARGINS).toPandas()
    tokens = cells["tokens"].to_numpy(float)
    if not len(cells) or not tokens.sum():
        return rows.select("doc_id", *MARGINS, "n_tokens", F.lit(float(rate)).alias("chance"), F.lit(1.0).alias("weight"), (draw(F.col("doc_id"), seed) < rate).alias("sampled"), *carried)
    codes, wanted = [], []
    for m in MARGINS:
        code, names = cells[m].factorize(sort=True)
        seen = np.bincount(code, tokens, len(names))
        given = (targets or {}).get(m)
        if given and m in rest:
            given = {**given, "(other)": rest[m]}
        goal = np.array([float(given.get(x, 0.0)) for x in names]) * (seen > 0) if given else np.power(seen, powers[m], out=np.zeros(len(seen)), where=seen > 0)
        if not goal.sum():
            raise ValueError(f"no target of {m} has tokens")
        codes.append(code)
        wanted.append(goal / goal.sum())
    weights = rake(tokens, codes, wanted, rounds, tolerance)
    f = factor(tokens, weights, rate)
    cells["chance"] = np.where(tokens > 0, np.minimum(1, f * weights), rate)
    cells["weight"] = np.where(tokens > 0, np.maximum(1, f * weights), 1.0)
    # from an Arrow table no executor has to start Python workers of another kind, which would stay
    table = spark.createDataFrame(pa.Table.from_pandas(cells[[*MARGINS, "chance", "weight"]], preserve_index=False))
    if len(cells) <= BROADCAST_CELLS:
        table = F.broadcast(table)
    out = rows.join(table, list(MARGINS))
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("chance", 9).alias("chance"), F.round("weight", 9).alias("weight"), (draw(F.col("doc_id"), seed) < F.round("chance", 9)).alias("sampled"), *carried)


def oracle(powers: dict[str, float] = POWERS, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same in DuckDB SQL, the rounds written out, the factor found where the cut cells are known."""
    parts = [
        """rows as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
    case when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '***') or contains(coalesce(text, ''), '!!') then 'noisy'
         when length(coalesce(text, '')) < 400 then 'short' when length(coalesce(text, '')) < 4000 then 'article' else 'long' end as topic,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as n_tokens from documents)""",
        "cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from rows group by all)",
    ]
    for m in MARGINS:
        parts.append(f"t_{m} as materialized (select {m}, pow(t, {powers[m]}) / sum(pow(t, {powers[m]})) over () as goal from (select {m}, sum(tokens) as t from cells group by {m}))")
    parts.append("r0 as materialized (select *, tokens / sum(tokens) over () as mass from cells)")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"r{k + 1} as materialized (select r.* exclude (mass), mass * goal / sum(mass) over (partition by r.{m}) as mass from r{k} r join t_{m} using ({m}))")
            k += 1
    parts += [
        f"w as materialized (select source, lang, topic, tokens, mass * sum(tokens) over () / tokens as weight from r{k})",
        # cells sorted by weight: for each number of cut cells the factor that the rest needs; the right one cuts just those
        f"s as (select *, coalesce(sum(tokens) over (order by weight desc rows between unbounded preceding and 1 preceding), 0) as cut, sum(tokens * weight) over (order by weight desc rows between current row and unbounded following) as rest, {rate} * sum(tokens) over () as goal, lag(weight) over (order by weight desc) as above from w)",
        "f as (select min((goal - cut) / rest) as f from s where (goal - cut) / rest * weight <= 1 + 1e-12 and (above is null or (goal - cut) / rest * above >= 1 - 1e-12))",
        "c as (select source, lang, topic, round(least(1, f * weight), 9) as chance, round(greatest(1, f * weight), 9) as weight from w, f)",
    ]
    return (
        "with " + ",\n".join(parts) + f"""
select doc_id, source, lang, topic, n_tokens, chance, weight, ('0x' || substr(md5(doc_id::varchar || ':{seed}'), 1, 8))::bigint / 4294967296.0 < chance as sampled
from rows join c using (source, lang, topic)"""
    )
