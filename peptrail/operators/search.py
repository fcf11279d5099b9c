"""Every occurrence of peptides in proteins, in suffix order, with a cutoff.

A peptide's first letters are its seed. Seeds of all positions meet seeds of peptides in an
equi-join, and the whole peptide is compared only there. A peptide list of a checked size is
broadcast, so texts are read once and only hits are shuffled; a longer list is joined by
shuffling (seed, protein, offset), without texts, where seeds of very many positions are split.
With a written seed index no text is expanded: only the files that hold a seed of the list are
read, and then those with a protein that was met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from peptrail.functions.peptides import folded, normal
from peptrail.operators.index import HEAD, LETTERS, SEED, protein_at
from peptrail.operators.settle import settle
from peptrail.operators.stored import Ordered

#: Peptide lists up to so many rows and bytes are broadcast.
BROADCAST_PEPTIDES, BROADCAST_BYTES = 200_000, 16 << 20
MARKS = "[-$]"
#: Up to so many distinct seeds of a search become at most ``RANGES`` ranges that the index scan filters by.
PUSHED_SEEDS, RANGES = 10_000, 64
#: A seed of one in so many positions is split; there are at most so many such seeds.
HOT = 1000


def _with_neighbours(prepared: DataFrame, marks: int) -> DataFrame:
    """``exact`` and ``text`` (folded) go on over ``marks`` separators into the next proteins."""
    end = F.substring(F.col("closed"), -1, 1)
    out = prepared.withColumns({"exact": F.concat("sequence", end), "text": F.col("closed")})
    for i in range(1, marks + 1):
        more = prepared.select((F.col("protein_idx") - i).alias("protein_idx"), F.concat("sequence", F.substring(F.col("closed"), -1, 1)).alias("more"))
        out = out.join(more, "protein_idx", "left").withColumns({"exact": F.concat("exact", F.coalesce("more", F.lit(""))), "text": F.concat("text", folded(F.coalesce("more", F.lit(""))))}).drop("more")
    return out


def _wanted(peptides: DataFrame, seed: int) -> tuple[DataFrame, Row]:
    """``(pep, pep_il, letters, seed)`` of distinct ``peptides(pep)``, and their number, bytes and lengths."""
    wanted = peptides.select("pep", folded(F.col("pep")).cast("binary").alias("pep_il"), F.col("pep").cast("binary").alias("letters"))
    wanted = wanted.withColumn("seed", F.substring("pep_il", 1, seed))
    length = F.length("letters")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"), F.collect_set(F.length("seed")).alias("lengths"), F.max(length).alias("longest")).first()  # at most ``seed`` lengths
    return wanted, size


def split_seeds(rows: DataFrame, shards: int) -> DataFrame:
    """``(seed, parts)`` of the seeds that one in ``HOT`` of ``rows(seed)`` has: a part is not more than one in ``shards`` rows."""
    counts = settle(rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    often = counts.join(F.broadcast(total)).where(F.col("n") * HOT >= F.col("total"))
    return often.select("seed", F.ceil(F.col("n") * shards / F.col("total")).cast("int").alias("parts")).where("parts > 1")


def _meet(rows: DataFrame, wanted: DataFrame, size: Row) -> DataFrame:
    """``rows(seed, protein_idx, off, …)`` with the peptides of the same seed."""
    if size.n <= BROADCAST_PEPTIDES and size.bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wanted), "seed")
    hot = F.broadcast(split_seeds(rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # at most HOT rows
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(hot, "seed", "left").withColumn("part", F.pmod(F.xxhash64("protein_idx", "off"), parts).cast("int")).drop("parts")
    right = wanted.join(hot, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["seed", "part"]).drop("part")


def _same(equalize: bool | None) -> str:
    """The comparison at ``off``; ``equalize`` None is as True, and the letters as they are make a column ``alike``."""
    equalize = equalize is not False
    return "substring(text, off + 1, length(pep_il)) = pep_il" if equalize else "substring(exact, off + 1, length(letters)) = letters"


def _alike(equalize: bool | None, alike: Column | str) -> list[Column]:
    return [(F.expr(alike) if isinstance(alike, str) else alike).alias("alike")] if equalize is None else []


def _join(texts: DataFrame, last: Column, peptides: DataFrame, equalize: bool | None, seed: int, keep: list[str]) -> DataFrame:
    """Rows ``pep, off, keep`` of ``texts(protein_idx, exact, text, keep)``; offsets run to ``last``."""
    wanted, size = _wanted(peptides, seed)
    if not size.n:
        return texts.where(F.lit(False)).select(F.lit("").alias("pep"), F.lit(0).alias("off"), *keep, *_alike(equalize, "true"))
    out = ["pep", "off", *(F.col(c) for c in keep), *_alike(equalize, _same(False))]
    bytes_ = texts.withColumns({"text": F.col("text").cast("binary"), "exact": F.col("exact").cast("binary"), "_last": last}).where("_last >= 0")
    seeds = F.array(*(F.expr(f"substring(text, off + 1, {n})") for n in sorted(size.lengths)))
    seeds = F.explode(F.array_distinct(seeds)) if len(size.lengths) > 1 else seeds[0]
    each = lambda *columns: bytes_.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("off")).select(*columns, "off", seeds.alias("seed"))
    if size.n <= BROADCAST_PEPTIDES and size.bytes <= BROADCAST_BYTES:
        return _meet(each("text", "exact", *keep), wanted, size).where(_same(equalize)).select(*out)
    met = _meet(each("protein_idx"), wanted, size).select("protein_idx", "off", "pep", "pep_il", "letters")
    return met.join(bytes_, "protein_idx").where(_same(equalize)).select(*out)


COLUMNS = ["protein_idx", "uniprot_id", "taxon_id", "fa", "start_pos", "tail", "closed"]


def occurrences(prepared: DataFrame, peptides: DataFrame, equalize: bool | None = False, seed: int = SEED, columns: list[str] | None = None, index: Ordered | DataFrame | None = None, stored: Ordered | None = None) -> DataFrame:
    """``(pep, off, …)``: every occurrence of the distinct ``peptides(pep)`` in normal form.

    A peptide with separators may reach into the next proteins; its hits name the protein of
    their first letter, and none (null) where that is a separator or the end mark. An empty
    peptide has no occurrence. Peptides without separators are looked up in ``index``, if given, and
    their proteins in ``stored``. With ``equalize`` None, folded letters are compared and ``alike`` says
    whether they are the same as they are.
    """
    keep = columns or COLUMNS
    some = peptides.select("pep").where(F.length("pep") > 0).distinct()
    plain = some.where(~F.col("pep").rlike(MARKS))
    if index is None:
        texts = prepared.withColumns({"exact": F.col("sequence"), "text": folded(F.col("sequence"))})
        found = _join(texts, F.octet_length("sequence") - 1, plain, equalize, seed, keep)
    else:
        found = indexed_occurrences(index, stored or prepared, plain, equalize, seed, keep)
    marked = some.where(F.col("pep").rlike(MARKS))
    most = marked.agg(F.max(F.regexp_count("pep", F.lit(MARKS)))).first()[0]
    if most is None:
        return found
    across = _join(_with_neighbours(prepared, most), F.octet_length("sequence"), marked, equalize, seed, [*keep, *({"sequence", "closed"} - {*keep})])
    on_mark = F.col("off") >= F.octet_length("sequence")
    nulled = {c: F.when(~on_mark, F.col(c)) for c in ("protein_idx", "uniprot_id", "taxon_id", "fa") if c in keep}
    return found.union(across.withColumns(nulled).select(*found.columns))


def _seed_ranges(wanted: DataFrame, seed: int) -> Column | None:
    """The part of an index that the ``seed``s of a list can meet, as at most ``RANGES`` ranges; of long lists, none.

    A seed shorter than the index's stands for all that start with it.
    """
    firsts = wanted.select("seed").distinct().limit(PUSHED_SEEDS + 1).collect()
    if len(firsts) > PUSHED_SEEDS:
        return None
    spans = sorted((bytes(r.seed), bytes(r.seed).ljust(seed, b"\xff")) for r in firsts)
    step = -(-len(spans) // RANGES) or 1
    at = F.col("seed")
    out = F.lit(False)
    for i in range(0, len(spans), step):
        run = spans[i : i + step]
        out = out | ((at >= F.lit(run[0][0])) & (at <= F.lit(max(high for _, high in run))))
    return out


def indexed_occurrences(index: Ordered | DataFrame, prepared: Ordered | DataFrame, peptides: DataFrame, equalize: bool | None = False, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """``(pep, off, …)`` by a seed index, for peptides without separators.

    Peptides shorter than a seed meet the first letters of the index's seeds. The index's own letters
    decide for peptides of up to ``LETTERS`` of them, so only longer ones need the proteins' texts. Of a
    written index, and of written proteins, only files with something to be met are read.
    """
    keep = columns or ["protein_idx"]
    wanted, size = _wanted(peptides.select("pep").where(F.length("pep") > 0).distinct(), seed)
    table = prepared.rows if isinstance(prepared, Ordered) else prepared
    if not size.n:
        return table.where(F.lit(False)).select(F.lit("").alias("pep"), F.lit(0).alias("off"), *keep, *_alike(equalize, "true"))
    rows = index
    if isinstance(index, Ordered):
        high = F.when(F.length("seed") < seed, F.concat("seed", F.unhex(F.lit("FF" * seed)))).otherwise(F.col("seed"))
        rows = index.meeting(wanted.select(F.col("seed").alias("low"), high.alias("high")))
        ranges = _seed_ranges(wanted, seed)
        rows = rows if ranges is None else rows.where(ranges)
    starts = F.array_distinct(F.array(*(F.expr(f"substring(seed, 1, {n})") for n in sorted(size.lengths))))
    each = rows.select("protein_idx", "off", F.col("letters").alias("near"), F.explode(starts).alias("seed"))
    exact = F.startswith("near", F.substring("letters", 1, LETTERS))
    near = exact if equalize is False else F.startswith(folded(F.col("near").cast("string")).cast("binary"), F.substring("pep_il", 1, LETTERS))
    met = _meet(each, wanted, size).where(F.col("near").isNull() | near)
    met = met.withColumns({"sure": F.col("near").isNotNull() & (F.length("letters") <= LETTERS), "alike": exact}).drop("near", "seed")
    out = ["pep", "off", *keep]
    table = table.withColumns({"exact": F.col("sequence").cast("binary"), "text": folded(F.col("sequence")).cast("binary")})
    if isinstance(prepared, Ordered):
        met = settle(met)
        table = prepared.meeting(met.select(F.col("protein_idx").alias("low"), F.col("protein_idx").alias("high")))
        table = table.withColumns({"exact": F.col("sequence").cast("binary"), "text": folded(F.col("sequence")).cast("binary")})
        if met.where("not sure").isEmpty():
            return met.join(table.select(*dict.fromkeys(["protein_idx", *keep])), "protein_idx").select(*out, *_alike(equalize, "alike"))
    met = met.join(table.select("exact", "text", *dict.fromkeys(["protein_idx", *keep])), "protein_idx").where("sure or " + _same(equalize))
    return met.select(*out, *_alike(equalize, F.when(F.col("sure"), F.col("alike")).otherwise(F.expr(_same(False)))))


def first_hits(hits: DataFrame, prepared: DataFrame, most: int, sparseness: int = 1, by: tuple[str, ...] = ("pep",)) -> DataFrame:
    """The first ``most`` hits (at least one) of each peptide, or of each ``by``, with their place ``rn``, from 1.

    The order is that of a search in a suffix array with every ``sparseness``-th suffix: first
    by how far behind the match the next indexed suffix starts, then by that suffix. A hit
    carries ``HEAD`` letters of it, and where its protein ends in them the rank of what follows.
    Only hits that stay, and share these letters with another one, look up the rest of their text.
    """
    n = F.octet_length("closed")
    skip = F.pmod(-(F.col("start_pos") + F.col("off")), F.lit(sparseness)).cast("int")
    head = F.expr(f"substring(closed, _at + 1, {HEAD})")
    ends = n - F.col("_at") <= HEAD  # the head reaches the mark behind the protein
    keyed = hits.withColumn("_skip", skip).withColumn("_at", F.col("off") + F.col("_skip"))
    keyed = keyed.withColumns({"_owner": F.col("start_pos"), "_head": head, "_after": F.when(ends, F.col("tail")).otherwise(0), "_far": F.col("_at") >= n}).drop("closed", "tail")
    if sparseness > 1:  # only behind peptides with separators the indexed suffix is in a later protein
        keyed = _across(keyed, prepared)
    order = Window.partitionBy(*by).orderBy("_skip", "_head", "_after")
    some = settle(keyed.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= max(most, 1)).drop("_rank", "_far"))
    alike = some.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_skip", "_head", "_after"))).where("_n > 1 and _after = 0").drop("_n")
    some = some.withColumn("_rest", F.lit(None).cast("string")).withColumn("_last", F.lit(None).cast("long"))
    if not alike.isEmpty():
        texts = prepared.select(F.col("start_pos").alias("_owner"), F.col("tail").alias("_last"), "closed")
        tied = alike.join(texts, "_owner").withColumn("_rest", F.expr(f"substring(closed, _at + 1 + {HEAD})")).select(*some.columns)
        keys = [*by, "start_pos", "off"]
        some = some.join(tied.select(*keys), keys, "left_anti").select(*tied.columns).union(tied)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_skip", "_head", "_after", "_rest", "_last", "start_pos", "off"))
    return some.withColumn("rn", place).where(F.col("rn") <= max(most, 1)).drop("_skip", "_at", "_owner", "_head", "_after", "_rest", "_last")


def _across(keyed: DataFrame, prepared: DataFrame) -> DataFrame:
    """Hits whose next indexed suffix starts in a later protein, with that one's head."""
    far = settle(keyed.where("_far").withColumn("pos", F.col("start_pos") + F.col("_at")))
    if far.isEmpty():
        return keyed
    own = ["_at", "_owner", "_head", "_after", "_far"]
    homes = protein_at(far.select("pos").distinct(), prepared, marks=True)
    texts = prepared.select("protein_idx", F.col("start_pos").alias("_owner"), "tail", "closed")
    found = homes.join(texts, "protein_idx").drop("protein_idx").withColumn("_at", (F.col("pos") - F.col("_owner")).cast("int"))
    ends = F.octet_length("closed") - F.col("_at") <= HEAD
    found = found.select("pos", "_at", "_owner", F.expr(f"substring(closed, _at + 1, {HEAD})").alias("_head"), F.when(ends, F.col("tail")).otherwise(0).alias("_after"), F.lit(True).alias("_far"))
    return keyed.where("not _far").union(far.drop(*own).join(found, "pos").drop("pos").select(*keyed.columns))


def exists(prepared: DataFrame, peptides: DataFrame, equalize: bool = False, index: Ordered | None = None, stored: Ordered | None = None) -> DataFrame:
    """``peptides`` with ``found``; an empty peptide is found everywhere."""
    named = peptides.withColumn("pep", normal(F.col("sequence")))
    there = occurrences(prepared, named, equalize, columns=["start_pos"], index=index, stored=stored).select("pep").distinct().withColumn("found", F.lit(True))
    return named.join(there, "pep", "left").withColumn("found", F.coalesce("found", F.col("pep") == "")).drop("pep")


def search_bounds(array: DataFrame, prepared: DataFrame, peptides: DataFrame) -> DataFrame:
    """``(pep, lo, hi)``: the half-open interval of ``array``'s ranks whose suffixes start with the folded peptide."""
    named = peptides.select(normal(F.col("sequence")).alias("pep"))
    hits = settle(occurrences(prepared, named, True, columns=["start_pos"]))
    at = hits.select("pep", (F.col("start_pos") + F.col("off")).alias("pos"))
    return at.join(array, "pos").groupBy("pep").agg(F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"))
