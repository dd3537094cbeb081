"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic.  Raking scales
the cells' token weights to each target marginal in turn until all three
hold to ``TOLERANCE``; targets that the cells cannot reach, or not in
``MOST_SWEEPS``, are reported by a warning with the error left.  A document's probability is its cell's fitted weight over its tokens,
times one factor for the whole corpus that makes the expected sample the
wanted share of all tokens (cells that reach 1 stay there).  Each document
is then kept or not by a number drawn from its id.

Targets are shares of tokens: given as a mapping for a marginal, or else the
actual shares raised to ``FLATTEN`` and scaled to 1, which lifts small
sources and languages.  Values missing in a mapping share what it leaves
over in proportion to their tokens.

Tokens are words and one end mark, so that empty documents weigh something.

Defined results: NULL source, language or text count as ``(none)`` and as
the empty text; equal ids get the same decision; an empty table stays empty.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenoframe.llm.sharding import draw, key_text
from phenoframe.llm.stages import cut, small
from phenoframe.llm.text import words

MARGINALS = ("source", "lang", "topic")
CELL = "source string, lang string, topic string"
#: Exponent on the actual shares where no target is given.
FLATTEN = 0.7
#: Share of all tokens that the sample is expected to hold.
KEEP = 0.5
#: Fewest and most sweeps over the marginals, and the error of a value's share of all tokens at which they end.
SWEEPS, MOST_SWEEPS = 12, 2_000
TOLERANCE = 1e-5
#: Sweeps between two tests on the executors, where each sweep is a pass.
SWEEPS_BETWEEN = 4
#: Cells up to which the driver rakes the table of cells; a larger one is raked by window sums on the executors, to the same weights.
FEW_CELLS = 50_000
#: Rounds of the search for the common factor in the SQL oracle; here it goes on until no further cell reaches 1.
FACTOR_ROUNDS = 12
DRAW_SALT = ":mix"
NONE = "(none)"
# Fixed values of the topic rules.
DIGITS = "0123456789"


def topic_of(text: Column) -> Column:
    """Register of a text, for tables without a topic: figures, list, long or short prose, or empty."""
    n = F.length(text)
    digits = n - F.length(F.translate(text, DIGITS, ""))
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (F.when(n == 0, "empty").when(digits * 50 >= n, "figures").when(lines * 80 >= n, "list")
            .when(n >= 4000, "long").otherwise("short"))


def with_marginals(docs: DataFrame, tokens: str) -> DataFrame:
    """``docs`` with its marginals filled in (topic only where it has none) and its token weight."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.col("topic") if "topic" in docs.columns else topic_of(text)
    return (docs.withColumn("topic", F.coalesce(topic, F.lit(NONE))).withColumn("source", F.coalesce("source", F.lit(NONE)))
            .withColumn("lang", F.coalesce("lang", F.lit(NONE))).withColumn(tokens, (F.size(words(F.col("text"))) + 1).cast("long")))


def target_shares(sums: DataFrame, name: str, target: Mapping[str, float] | None) -> DataFrame:
    """Target share of each value of a marginal; ``sums`` has its values and their ``tokens``."""
    if target is None:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(FLATTEN))
        total = sums.agg(F.sum(raw)).first()[0]
        return sums.select(name, (raw / F.lit(total)).alias(f"{name}_share"))
    given = F.create_map(*[F.lit(x) for pair in target.items() for x in pair]) if target else F.create_map().cast("map<string,double>")
    sums = sums.withColumn("given", F.try_element_at(given, F.col(name)).cast("double"))
    found = sums.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("tokens")))).first()
    held, loose = float(found[0] or 0), float(found[1] or 0)
    rest = max(0.0, 1.0 - held) if loose else 0.0
    share = F.coalesce("given", F.col("tokens") * F.lit(rest / loose if loose else 0.0)) / F.lit((held + rest) or 1.0)
    return sums.select(name, share.alias(f"{name}_share"))


def report(error: float) -> None:
    if error > TOLERANCE:
        warnings.warn(f"raking stopped with a marginal share off by {error:.2g}; the targets may be out of reach of the cells", RuntimeWarning, stacklevel=3)


def rake(cells: pd.DataFrame, total: float, sweeps: int, most: int = MOST_SWEEPS) -> pd.DataFrame:
    """Cells with their weights scaled to each marginal's shares in turn."""
    error = 0.0
    for i in range(max(sweeps, most)):
        for name in MARGINALS:
            held = cells.groupby(name)["weight"].transform("sum")
            cells["weight"] = (cells["weight"] * cells[f"{name}_share"] * total / held).where(held > 0, 0.0)
        if i + 1 >= sweeps:
            error = max(float((cells.groupby(c)["weight"].transform("sum") / total - cells[f"{c}_share"]).abs().max()) for c in MARGINALS)
            if error <= TOLERANCE:
                break
    report(error)
    return cells[[*MARGINALS, "tokens", "weight"]]


def largest_error(wide: DataFrame, total: float) -> float:
    """Largest error of a value's share of all weights."""
    return max(wide.groupBy(c).agg((F.sum("weight") / F.lit(total) - F.first(f"{c}_share")).alias("error"))
               .agg(F.max(F.abs("error"))).first()[0] for c in MARGINALS)


def fitted_cells(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with their ``tokens`` and fitted ``weight``; ``rows`` has the marginals and ``tokens``."""
    cells = cut(rows.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    wide = cells
    for name in MARGINALS:
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"))
        wide = wide.join(target_shares(sums, name, (targets or {}).get(name)), name)
    wide = cut(wide.withColumn("weight", F.col("tokens").cast("double")))
    if wide.count() <= FEW_CELLS:
        return cells.sparkSession.createDataFrame(rake(wide.toPandas(), float(total), sweeps), f"{CELL}, tokens long, weight double")
    error = 0.0
    for i in range(max(sweeps, MOST_SWEEPS)):
        for name in MARGINALS:
            held = F.sum("weight").over(Window.partitionBy(name))
            scaled = F.col("weight") * F.col(f"{name}_share") * F.lit(float(total)) / held
            wide = wide.withColumn("weight", F.when(held > 0, scaled).otherwise(F.lit(0.0)))
        wide = cut(wide)
        if i + 1 >= sweeps and (i + 1 - sweeps) % SWEEPS_BETWEEN == 0:
            error = largest_error(wide, float(total))
            if error <= TOLERANCE:
                break
    report(error)
    return cut(wide.select(*MARGINALS, "tokens", "weight"))


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """``cells`` with the probability of their documents."""
    wanted = keep * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor, full = 0.0, -1
    while True:  # each round but the last has more cells that reach 1
        whole = F.col("weight") * F.lit(factor) >= F.col("tokens")
        found = cells.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight"))), F.count(F.when(whole, 1))).first()
        if found[2] <= full or not found[1]:
            break
        full, factor = found[2], max(0.0, wanted - float(found[0] or 0)) / found[1]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(factor) / F.col("tokens")))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """One row per document: marginals, tokens, probability and decision."""
    narrow = with_marginals(docs, "tokens").select("doc_id", *MARGINALS, "tokens")
    cells = probabilities(fitted_cells(narrow, targets), keep).select(*MARGINALS, "probability")
    return (narrow.join(small(cells), list(MARGINALS))
            .withColumn("kept", draw(key_text(F.col("doc_id")), DRAW_SALT) < F.col("probability")))


def mix_report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", *MARGINALS, "tokens", F.round("probability", 6).alias("probability"), "kept")


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, in the columns of ``docs``."""
    names = docs.columns
    marked = docs.select(*[F.col(c) for c in ("doc_id", "source", "lang", "text")], *([F.col("topic")] if "topic" in names else []),
                         F.struct(*names).alias("row"))
    filled = with_marginals(marked, "tokens")
    cells = probabilities(fitted_cells(filled.select(*MARGINALS, "tokens"), targets), keep).select(*MARGINALS, "probability")
    kept = filled.join(small(cells), list(MARGINALS)).where(draw(key_text(F.col("doc_id")), DRAW_SALT) < F.col("probability"))
    return kept.select("row.*")
