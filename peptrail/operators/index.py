"""The text of all proteins, the order of its suffixes, and the seed index.

The text joins all sequences by ``-`` and ends in ``$``; it is never built. A suffix starts
in one protein, and is ordered by the rest of that protein and then by the rank of the text
from the next protein on, which is found by doubling over proteins instead of positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.peptides import folded
from peptrail.operators.settle import numbered, running_sum, settle
from peptrail.operators.stored import write_ordered

SEED = 5
#: Letters that a row of the seed index holds: peptides of up to so many are told by it alone.
LETTERS = 16
#: Letters that suffixes are first ordered by, rounded up to a multiple of the sparseness.
HEAD = 32
#: Stretches of text whose ranks a round of ``_doubled`` puts together.
WAYS = 8


def _doubled(ranked: DataFrame, at: str, step: int = 1, rounds: list[tuple[int, DataFrame]] | None = None, ways: int = WAYS) -> DataFrame:
    """``ranked`` by whole texts from each ``at`` on, given ``r``: ranks, from 1 without gaps, of their first ``step`` places.

    A round puts the ranks of ``ways`` neighbouring stretches together, so each has ``ways`` times as many places.
    ``rounds`` is told of the ranks that do not tell all texts apart, with their ``step``.
    """
    others = [c for c in ranked.columns if c != "r"]
    rs = ["r", *(f"r{j}" for j in range(1, ways))]
    while True:
        n = ranked.agg(F.count(F.lit(1)).alias("rows"), F.max("r").alias("kinds")).first()
        if n.rows == (n.kinds or 0):
            return ranked
        if rounds is not None:
            rounds.append((step, ranked))
        # One shuffle brings a place and the ranks behind it together; places before the first one have no rank of their own.
        each = ranked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).withColumn("_at", F.col(at) - F.col("_j") * step)
        own = [F.max(F.when(F.col("_j") == 0, F.col(c))).alias(c) for c in [*others, "r"]]
        ahead = [F.coalesce(F.max(F.when(F.col("_j") == j, F.col("r"))), F.lit(0)).alias(f"r{j}") for j in range(1, ways)]
        tuples = settle(each.groupBy("_at").agg(*own, *ahead).where("r is not null").drop("_at"))
        order = numbered(tuples.select(*rs).distinct(), rs, "next", 1)
        ranked = settle(tuples.join(order, rs).select(*others, F.col("next").alias("r")))
        step *= ways


def prepare(proteins: DataFrame) -> DataFrame:
    """``proteins(protein_idx, uniprot_id, taxon_id, sequence, fa)``, numbered from 0 without gaps, with

    ``start_pos`` (where its sequence starts in the text), ``closed`` (folded sequence and the
    separator or end mark after it) and ``tail`` (rank of the text from the next protein on; 0: none).
    """
    rows = proteins.withColumn("sequence", F.upper("sequence"))
    last = rows.agg(F.max("protein_idx").alias("last"))  # one row
    started = running_sum(rows.select("protein_idx", (F.octet_length("sequence") + 1).cast("long").alias("size")), ["protein_idx"], F.col("size"), "start_pos").drop("size")
    closed = settle(rows.join(F.broadcast(last)).withColumn("closed", F.concat(folded(F.col("sequence")), F.when(F.col("protein_idx") == F.col("last"), "$").otherwise("-"))).drop("last"))
    order = numbered(closed.select("closed").distinct(), ["closed"], "r", 1)
    ranks = _doubled(settle(closed.select("protein_idx", "closed").join(order, "closed").select("protein_idx", "r")), "protein_idx")
    tails = ranks.select((F.col("protein_idx") - 1).alias("protein_idx"), F.col("r").alias("tail"))
    return settle(closed.join(started, "protein_idx").join(tails, "protein_idx", "left").withColumn("tail", F.coalesce("tail", F.lit(0))))


def suffix_array(prepared: DataFrame, sparseness: int = 1) -> DataFrame:
    """``(rank, pos, protein_idx)`` of the suffixes at every ``sparseness``-th position, from rank 0.

    ``protein_idx`` is null where the suffix starts on a separator or the end mark. Suffixes are
    first ranked by some ``HEAD`` letters, and by ``tail`` where their protein ends in them; ties
    then look so many letters ahead, twice as many in each round, so a row never holds more text.
    """
    if not 1 <= sparseness <= 255:
        raise ValueError("sparseness must be 1 to 255")
    step = -(-HEAD // sparseness) * sparseness  # the suffix so far ahead is in the array, too
    ranks = _doubled(settle(_by_heads(prepared, sparseness, step).select("pos", "protein_idx", "r")), "pos", step)
    return ranks.select((F.col("r") - 1).alias("rank"), "pos", "protein_idx")


def _by_heads(prepared: DataFrame, sparseness: int, head: int) -> DataFrame:
    """``(pos, protein_idx, head, rest, r)``: rank of each suffix by ``head`` letters, and by ``tail`` where its protein ends in them; ``rest`` counts the letters up to that end."""
    text = prepared.select("protein_idx", "start_pos", "tail", F.col("closed").cast("binary").alias("closed"))
    body = text.select("*", F.explode(F.sequence(F.lit(0), F.length("closed") - 1)).alias("off"), F.length("closed").alias("size"))
    at = body.where(F.pmod(F.col("start_pos") + F.col("off"), F.lit(sparseness)) == 0).select(
        (F.col("start_pos") + F.col("off")).alias("pos"),
        F.when(F.col("off") < F.col("size") - 1, F.col("protein_idx")).alias("protein_idx"),
        F.expr(f"substring(closed, off + 1, {head})").alias("head"),
        (F.col("size") - 1 - F.col("off")).alias("rest"),
        F.when(F.col("size") - F.col("off") <= head, F.col("tail")).otherwise(0).alias("after"),
    )
    order = numbered(at.select("head", "after").distinct(), ["head", "after"], "r", 1)
    return at.join(order, ["head", "after"]).drop("after")


def ranked_suffixes(prepared: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[int, DataFrame]]]:
    """The suffix array, its suffixes by their first ``HEAD`` letters (see ``_by_heads``), and the ranks that came before: ``(letters, (pos, r))``."""
    heads, rounds = settle(_by_heads(prepared, 1, HEAD)), []
    ranks = _doubled(heads.select("pos", "protein_idx", "r"), "pos", HEAD, rounds, 2)  # a pair of neighbours then moves at most once a round
    return ranks.select((F.col("r") - 1).alias("rank"), "pos", "protein_idx"), heads, [(step, r.select("pos", "r")) for step, r in rounds]


def protein_at(positions: DataFrame, prepared: DataFrame, block: int = 4096, marks: bool = False) -> DataFrame:
    """``positions(pos)`` with ``protein_idx``; null on separators, the end mark and outside the text.

    With ``marks``, the mark behind a protein belongs to it.

    The as-of lookup is an equi-join on blocks of the text: a protein is listed under every block it touches.
    """
    end = F.col("start_pos") + F.octet_length("closed") - (0 if marks else 1)
    ranges = prepared.select("protein_idx", "start_pos", end.alias("end_pos")).where("end_pos > start_pos")
    ranges = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_pos") / block), F.floor((F.col("end_pos") - 1) / block))))
    inside = (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))
    left = positions.withColumn("block", F.floor(F.col("pos") / block)).alias("l")
    return left.join(ranges.alias("r"), (F.col("l.block") == F.col("r.block")) & inside, "left").select("l.*", "r.protein_idx").drop("block")


def seed_index(prepared: DataFrame, size: int = SEED, letters: int = LETTERS) -> DataFrame:
    """``(seed, protein_idx, off, letters)``: the folded letters from every position on, and more of them as they are; fewer at a protein's end."""
    text = prepared.select("protein_idx", folded(F.col("sequence")).cast("binary").alias("text"), F.col("sequence").cast("binary").alias("exact")).where(F.length("text") > 0)
    each = text.select("protein_idx", "text", "exact", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("off"))
    plain = F.expr("length(exact) = char_length(cast(exact as string))")  # others are left to a comparison of texts
    return each.select(F.expr(f"substring(text, off + 1, {size})").alias("seed"), "protein_idx", "off", F.when(plain, F.expr(f"substring(exact, off + 1, {letters})")).alias("letters"))


def write_index(prepared: DataFrame, path: str, size: int = SEED) -> None:
    """The seed index in the order of seeds; see ``stored``."""
    rows = prepared.agg(F.coalesce(F.sum(F.octet_length("sequence")), F.lit(0))).first()[0]
    write_ordered(seed_index(prepared, size), path, "seed", ["seed", "protein_idx", "off"], rows)


def prefix_lca(prepared: DataFrame, paths: DataFrame, most: int = 3) -> DataFrame:
    """``(prefix, n, lca)`` for every string of up to ``most`` letters that occurs in a protein."""
    from peptrail.operators.taxonomy import lowest_common_ancestor

    text = prepared.where(F.length("sequence") > 0).select("taxon_id", "sequence", F.explode(F.expr("sequence(1, length(sequence))")).alias("at"), F.lit(most).alias("most"))
    each = text.select("taxon_id", F.explode(F.expr("transform(sequence(1, least(most, length(sequence) - at + 1)), m -> substring(sequence, at, m))")).alias("prefix"))
    counted = settle(each.groupBy("prefix", "taxon_id").agg(F.count(F.lit(1)).alias("k")))
    lca = lowest_common_ancestor(counted, paths, "prefix")
    return counted.groupBy("prefix").agg(F.sum("k").alias("n")).join(lca, "prefix").select("prefix", "n", "lca")
