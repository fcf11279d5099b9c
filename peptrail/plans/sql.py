"""The engine in SQL text: views of a database, and functions for codecs and searches.

After ``register(engine)`` a session knows the views ``proteins``, ``taxonomy``, ``lineage``,
``seeds`` (the seed index, in letters) and ``short_seeds`` (its shorter beginnings), the functions
``pack_annotations``, ``unpack_annotations``, ``normal_peptide``, ``folded`` and ``matches_at``, and
the table functions ``matches(peptide, equalize)`` and ``short_matches(peptide, equalize)`` for
peptides of a seed's length and more, and of less. A search is a lateral join, which the
optimizer turns into an equi-join on seeds:

    SELECT q.ord, p.uniprot_id, p.start_pos + m.off AS pos
    FROM peptides q, LATERAL matches(q.sequence, true) m
    JOIN proteins p ON p.protein_idx = m.protein_idx AND matches_at(p.sequence, m.off, q.sequence, true)

``matches`` compares the index's own letters; ``matches_at`` decides for longer peptides.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from peptrail.functions.annotations import ALPHABET, CODES, PREFIXES
from peptrail.operators.index import LETTERS, seed_index
from peptrail.plans.engine import PeptideEngine


def _kinds(form: str) -> str:
    return ", ".join(form.format(prefix=p, kind=p[: p.index(":")], after=len(p) + 1, place=i) for i, p in enumerate(PREFIXES))


#: Bodies of the scalar functions; each is the SQL of the column function of the same name.
_STRIPPED = "array_join(transform(filter(split(fa, ';'), x -> startswith(x, '{kind}')), x -> substring(x, {after})), ';')"
_NAMED = "transform(filter(split(coalesce(get(kinds, {place}), ''), ';'), x -> x <> ''), x -> concat('{prefix}', x))"
_SCALARS = {
    "annotation_symbols(fa STRING) RETURNS STRING": f"concat_ws(',', {_kinds(_STRIPPED)})",
    "packed_symbols(symbols STRING) RETURNS BINARY": f"""CASE WHEN symbols RLIKE '^[$0-9\\\\-.,;]*$' THEN unhex(translate(rpad(symbols, length(symbols) + length(symbols) % 2, '$'), '{ALPHABET}', '{CODES}'))
        ELSE raise_error(concat('cannot pack: ', symbols)) END""",
    "pack_annotations(fa STRING) RETURNS BINARY": "CASE WHEN fa = '' THEN X'' WHEN fa IS NOT NULL THEN packed_symbols(annotation_symbols(fa)) END",
    "named_annotations(kinds ARRAY<STRING>) RETURNS STRING": f"array_join(concat({_kinds(_NAMED)}), ';')",
    "unpack_annotations(packed BINARY) RETURNS STRING": f"""CASE WHEN contains(translate(hex(packed), '{CODES}F', '{ALPHABET}?'), '?') THEN raise_error(concat('cannot unpack: ', hex(packed)))
        WHEN packed IS NOT NULL THEN named_annotations(split(trim(TRAILING '$' FROM translate(hex(packed), '{CODES}', '{ALPHABET}')), ',')) END""",
    "normal_peptide(peptide STRING) RETURNS STRING": r"upper(regexp_replace(peptide, '\\n\\z', ''))",
    "folded(letters STRING) RETURNS STRING": "translate(letters, 'L', 'I')",
    "matches_at(text STRING, off INT, peptide STRING, equalize BOOLEAN) RETURNS BOOLEAN": """CASE WHEN equalize THEN substring(CAST(folded(text) AS BINARY), off + 1, octet_length(normal_peptide(peptide))) = CAST(folded(normal_peptide(peptide)) AS BINARY)
        ELSE substring(CAST(text AS BINARY), off + 1, octet_length(normal_peptide(peptide))) = CAST(normal_peptide(peptide) AS BINARY) END""",
}


def _matches(view: str, column: str, seed: int, longer: bool) -> str:
    near = f"(letters IS NULL OR CASE WHEN equalize THEN startswith(folded(letters), folded(substring(normal_peptide(peptide), 1, {LETTERS}))) ELSE startswith(letters, substring(normal_peptide(peptide), 1, {LETTERS})) END)"
    length = f"length(normal_peptide(peptide)) {'>=' if longer else '<'} {seed}"
    return f"SELECT protein_idx, off FROM {view} WHERE {column} = substring(folded(normal_peptide(peptide)), 1, {seed}) AND {length} AND {near}"


def functions(spark: SparkSession) -> None:
    """The scalar functions alone."""
    for head, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register(engine: PeptideEngine) -> None:
    """Views of an engine's database and all functions, in its session."""
    spark = engine.proteins.sparkSession
    engine.proteins.createOrReplaceTempView("proteins")
    engine.taxonomy.createOrReplaceTempView("taxonomy")
    engine.paths.createOrReplaceTempView("lineage")
    rows = engine.seeds.rows if engine.seeds is not None else seed_index(engine.proteins, engine.seed)
    rows = rows.select(F.col("seed").cast("string").alias("seed"), "protein_idx", "off", F.col("letters").cast("string").alias("letters"))
    rows.createOrReplaceTempView("seeds")
    shorter = rows.withColumn("n", F.explode(F.array(*(F.lit(i) for i in range(1, engine.seed))))).where(F.length("seed") >= F.col("n"))
    shorter.select(F.expr("substring(seed, 1, n)").alias("start"), "protein_idx", "off", "letters").createOrReplaceTempView("short_seeds")
    functions(spark)
    table = "RETURNS TABLE(protein_idx BIGINT, off INT) RETURN"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION matches(peptide STRING, equalize BOOLEAN) {table} {_matches('seeds', 'seed', engine.seed, True)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION short_matches(peptide STRING, equalize BOOLEAN) {table} {_matches('short_seeds', 'start', engine.seed, False)}")
