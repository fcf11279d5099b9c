"""Batch search and analysis of peptides over a protein database."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.functions.annotations import split, unpack
from peptrail.functions.peptides import normal
from peptrail.operators import search
from peptrail.operators.functional import functional_summary
from peptrail.operators.index import SEED, prepare, write_index
from peptrail.operators.settle import settle, shuffled
from peptrail.operators.stored import Ordered, write_ordered
from peptrail.operators.taxonomy import ROOT, clean, known, lineage, lowest_common_ancestor

CUTOFF = 10_000


class PeptideEngine:
    """``proteins(protein_idx, uniprot_id, taxon_id, sequence, fa)`` and ``taxonomy(id, name, rank, parent, valid)``.

    Proteins of unknown taxa are left out; ``protein_idx`` must then have no gaps (see ``load``).
    ``fa`` may be packed bytes, which are unpacked for the hits of a search only, or null.
    """

    def __init__(self, proteins: DataFrame, taxonomy: DataFrame, sparseness: int = 1, seed: int = SEED):
        if not 1 <= sparseness <= 255:
            raise ValueError("sparseness must be 1 to 255")
        self.taxonomy, self.sparseness, self.seed = taxonomy, sparseness, seed
        self.proteins = prepare(proteins)
        self.seeds: Ordered | None = None  # a written seed index
        self.stored: Ordered | None = None  # the written proteins
        self._paths: DataFrame | None = None

    @classmethod
    def load(cls, proteins: DataFrame, taxonomy: DataFrame, order: str, sparseness: int = 1, seed: int = SEED) -> PeptideEngine:
        """Rows ``(order, uniprot_id, taxon_id, sequence[, fa])`` of known taxa, numbered by ``order``."""
        from peptrail.operators.settle import numbered

        proteins = proteins if "fa" in proteins.columns else proteins.withColumn("fa", F.lit(None).cast("string"))
        rows = numbered(known(proteins, taxonomy), [order], "protein_idx").select("protein_idx", "uniprot_id", "taxon_id", "sequence", "fa")
        return cls(rows, taxonomy, sparseness, seed)

    def save(self, path: str) -> None:
        """The prepared database and its seed index as Parquet under ``path``; its settings are written last."""
        write_ordered(self.proteins, f"{path}/proteins", "protein_idx", ["protein_idx"])
        self.taxonomy.write.parquet(f"{path}/taxonomy")
        self.paths.write.parquet(f"{path}/paths")
        write_index(self.proteins, f"{path}/seeds", self.seed)
        self.proteins.sparkSession.createDataFrame([(self.sparseness, self.seed)], "sparseness int, seed int").write.parquet(f"{path}/settings")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PeptideEngine:
        """A saved database: nothing is prepared again, and searches go through its seed index."""
        engine = cls.__new__(cls)
        engine.sparseness, engine.seed = spark.read.parquet(f"{path}/settings").first()
        engine.taxonomy, engine._paths = (shuffled(spark.read.parquet(f"{path}/{name}")) for name in ("taxonomy", "paths"))
        engine.stored, engine.seeds = Ordered(spark, f"{path}/proteins", "protein_idx"), Ordered(spark, f"{path}/seeds", "seed")
        engine.proteins = engine.stored.rows
        return engine

    def at(self, sparseness: int) -> PeptideEngine:
        """The same prepared proteins, searched as by an index of another sparseness."""
        if not 1 <= sparseness <= 255:
            raise ValueError("sparseness must be 1 to 255")
        if sparseness == self.sparseness:
            return self
        other = copy.copy(self)
        other.sparseness = sparseness
        return other

    @property
    def paths(self) -> DataFrame:
        if self._paths is None:
            self._paths = lineage(self.taxonomy)
        return self._paths

    def occurrences(self, peptides: DataFrame, equalize: bool = False) -> DataFrame:
        """``(pep, protein_idx, uniprot_id, taxon_id, pos)``, without a cutoff, of ``peptides(pep)`` as they are."""
        hits = search.occurrences(self.proteins, peptides, equalize, self.seed, ["protein_idx", "uniprot_id", "taxon_id", "start_pos"], self.seeds, self.stored)
        return hits.where("protein_idx is not null").select("pep", "protein_idx", "uniprot_id", "taxon_id", (F.col("start_pos") + F.col("off")).alias("pos"))

    def _asked(self, peptides: DataFrame, cutoff: int, equalize: bool, clean_taxa: bool) -> tuple[DataFrame, int]:
        """Peptides in normal form that are long enough, with the query that they share and its options."""
        rows = peptides
        for name, value in (("cutoff", cutoff), ("equalize", equalize), ("clean", clean_taxa)):
            rows = rows if name in rows.columns else rows.withColumn(name, F.lit(value))
        rows = rows.select("ord", "sequence", F.greatest(F.col("cutoff").cast("long"), F.lit(0)).alias("cutoff"), "equalize", "clean", normal(F.col("sequence")).alias("pep"))
        rows = rows.where(F.octet_length("pep") >= self.sparseness).withColumn("query", F.concat_ws(" ", "cutoff", F.col("equalize").cast("string"), F.col("clean").cast("string"), "pep"))
        most = cutoff if "cutoff" not in peptides.columns else rows.agg(F.max("cutoff")).first()[0] or 0
        return rows, most

    def _answers(self, peptides: DataFrame, cutoff: int, equalize: bool, clean_taxa: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Asked rows, ``(query, cutoff_used)`` of the queries with matches, and their hits in proteins."""
        asked, most = self._asked(peptides, cutoff, equalize, clean_taxa)
        mixed = "equalize" in peptides.columns
        hits = search.occurrences(self.proteins, asked, None if mixed else equalize, self.seed, index=self.seeds, stored=self.stored)
        by = ("pep", "equalize") if mixed else ("pep",)
        if mixed:  # folded hits are found once, and are hits of the ways they were asked for
            hits = hits.join(asked.select(*by).distinct(), "pep").where("equalize or alike").drop("alike")
        hits = search.first_hits(hits, self.proteins, most, self.sparseness, by)
        queries = asked.select("query", *by, "cutoff", "clean").distinct()
        hits = settle(hits.join(queries, [*by]).where(F.col("rn") <= F.greatest("cutoff", F.lit(1))))
        found = hits.groupBy("query", "cutoff").agg(F.max("rn").alias("n")).select("query", (F.col("n") >= F.col("cutoff")).alias("cutoff_used"))
        inside = hits.where("protein_idx is not null").withColumn("fa", self._annotations())
        if "clean" not in peptides.columns:
            return asked, found, clean(inside, self.taxonomy) if clean_taxa else inside
        valid = self.taxonomy.where("valid").select(F.col("id").alias("taxon_id"), F.lit(True).alias("_valid"))
        return asked, found, inside.join(valid, "taxon_id", "left").where("_valid or not clean").drop("_valid")

    def _annotations(self) -> Column:
        return unpack(F.col("fa")) if self.proteins.schema["fa"].dataType.typeName() == "binary" else F.col("fa")

    def search(self, peptides: DataFrame, cutoff: int = CUTOFF, equalize: bool = False, clean_taxa: bool = False) -> DataFrame:
        """``(ord, sequence, proteins, cutoff_used)`` for each of ``peptides(ord, sequence[, cutoff, equalize, clean])`` with a match.

        Options may be columns, so requests with different ones are one search. At most ``cutoff`` proteins are listed, in suffix order; a protein is listed once per occurrence.
        """
        asked, found, hits = self._answers(peptides, cutoff, equalize, clean_taxa)
        info = F.struct(F.col("taxon_id").alias("taxon"), F.col("uniprot_id").alias("uniprot_accession"), split(F.col("fa")).alias("functional_annotations"))
        lists = hits.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", info.alias("x")))), lambda p: p["x"]).alias("proteins"))
        none = F.array().cast(lists.schema["proteins"].dataType)
        return asked.join(found, "query").join(lists, "query", "left").select("ord", "sequence", F.coalesce("proteins", none).alias("proteins"), "cutoff_used")

    def analyse(self, peptides: DataFrame, cutoff: int = CUTOFF, equalize: bool = False, clean_taxa: bool = False) -> DataFrame:
        """``(ord, sequence, lca, taxa, uniprot_accession_numbers, fa, cutoff_used)`` for each peptide with an LCA*.

        A search that reached its cutoff has the root as its LCA.
        """
        asked, found, hits = self._answers(peptides, cutoff, equalize, clean_taxa)
        lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rn", "taxon_id", "uniprot_id"))).alias("x"))
        whole = hits.join(found.where("not cutoff_used"), "query", "left_semi")
        lca = lowest_common_ancestor(whole, self.paths, "query", star=True).select("query", "lca")
        zero = F.lit(0).cast("long")
        nothing = F.struct(F.create_map(F.lit("all"), zero, F.lit("EC"), zero, F.lit("GO"), zero, F.lit("IPR"), zero).alias("counts"), F.create_map().cast("map<string,bigint>").alias("data"))
        out = asked.join(found, "query").join(lists, "query", "left").join(functional_summary(hits, "query"), "query", "left").join(lca, "query", "left")
        out = out.withColumn("lca", F.when(F.col("cutoff_used"), F.lit(ROOT).cast("long")).otherwise(F.col("lca"))).where("lca is not null")
        return out.select(
            "ord",
            "sequence",
            "lca",
            F.coalesce(F.transform("x", lambda p: p["taxon_id"]), F.array().cast("array<bigint>")).alias("taxa"),
            F.coalesce(F.transform("x", lambda p: p["uniprot_id"]), F.array().cast("array<string>")).alias("uniprot_accession_numbers"),
            F.coalesce("fa", nothing).alias("fa"),
            "cutoff_used",
        )

    def exists(self, peptides: DataFrame) -> DataFrame:
        """``peptides(ord, sequence)`` with ``found``; leucine and isoleucine differ here."""
        return search.exists(self.proteins, peptides, index=self.seeds, stored=self.stored)

    def matches(self, peptides: DataFrame) -> DataFrame:
        """``(ord, sequence, protein_idx, off, match)``: a row with the protein's letters for every occurrence; one with nulls without any."""
        asked = peptides.withColumn("pep", normal(F.col("sequence")))
        hits = search.occurrences(self.proteins, asked.select("pep").distinct(), False, self.seed, ["protein_idx"], self.seeds, self.stored)
        hits = settle(hits.where("protein_idx is not null").select("pep", "protein_idx", "off"))
        texts = self.proteins.select("protein_idx", F.col("sequence").alias("match"))
        return asked.join(hits.join(texts, "protein_idx"), "pep", "left").select("ord", "sequence", "protein_idx", "off", "match")

    def taxon(self, peptides: DataFrame) -> DataFrame:
        """``(ord, sequence, taxon)``: the snapped plain LCA of the peptide's proteins, null without a match.

        An occurrence may start on the letter after which a separator follows, but not on the separator.
        """
        named = peptides.withColumn("pep", normal(F.col("sequence")))
        hits = search.occurrences(self.proteins, named, False, self.seed, ["protein_idx", "taxon_id"], self.seeds, self.stored).where("protein_idx is not null")
        lca = lowest_common_ancestor(hits, self.paths, "pep").select("pep", F.col("lca").alias("taxon"))
        return named.join(lca, "pep", "left").select("ord", "sequence", "taxon")


def as_json(results: DataFrame) -> DataFrame:
    """``(ord, json)``: a result row as JSON, fields in order, without its ordinal; nulls are written."""
    fields = F.struct(*(c for c in results.columns if c != "ord"))
    return results.select("ord", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def as_lines(found: DataFrame) -> DataFrame:
    """``(ord, protein_idx, off, text)`` of ``found`` of ``exists``, ``taxon`` or ``matches``: a line that says ``true`` or
    ``false``, a taxon (``/``: none), or the number of matches and then a line for each; in this order of columns, nulls first."""
    nowhere = [F.lit(None).cast("long").alias("protein_idx"), F.lit(None).cast("int").alias("off")]
    if "found" in found.columns:
        return found.select("ord", *nowhere, F.col("found").cast("string").alias("text"))
    if "taxon" in found.columns:
        return found.select("ord", *nowhere, F.coalesce(F.col("taxon").cast("string"), F.lit("/")).alias("text"))
    heads = found.groupBy("ord").agg(F.count("protein_idx").alias("n")).select("ord", *nowhere, F.concat(F.lit("found "), F.col("n").cast("string"), F.lit(" matches")).alias("text"))
    return heads.union(found.where("protein_idx is not null").select("ord", "protein_idx", F.col("off").cast("int").alias("off"), F.concat(F.lit("* "), "match").alias("text")))


def as_text(found: DataFrame) -> DataFrame:
    """``(ord, text)``: the lines of each answer as one text, for lists to be read; write longer ones with ``write_text``."""
    lists = as_lines(found).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("protein_idx", "off", "text"))).alias("all"))
    return lists.select("ord", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))


def write_text(found: DataFrame, path: str) -> None:
    """The lines of all answers as text in input order; an answer with many matches is spread over files."""
    order = ["ord", "protein_idx", "off"]
    shards = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    as_lines(found).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("text").write.text(path)


def write_json(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines in input order: by ranges of ``ord`` over the files, sorted in each."""
    shards = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    as_json(results).repartitionByRange(shards, "ord").sortWithinPartitions("ord").select("json").write.text(path)


def document(results: DataFrame) -> str:
    """``{"result": […]}`` in input order, for the answer to one request; write larger results with ``as_json``."""
    return '{"result":[' + ",".join(r.json for r in as_json(results).orderBy("ord").toLocalIterator()) + "]}"
