"""The registered query of each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    alignment,
    bagminhash,
    bpe,
    decontaminate,
    exact_dedup,
    jaccard_join,
    licenses,
    line_dedup,
    pii,
    quality,
    secrets,
    suffix_dedup,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), tokenizer_path())
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP2_SQL = """
WITH line AS (
  SELECT doc_id, pos, l FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents WHERE text IS NOT NULL AND text <> '')
), first AS (
  SELECT l, min(struct_pack(d := doc_id, a := pos)) AS place, length(l) AS n
  FROM line WHERE regexp_matches(l, '[^ \\t]') GROUP BY l
), pair AS (
  SELECT x.l AS x, y.l AS y, x.place AS px, y.place AS py, x.n AS n, y.n - x.n AS more
  FROM first x JOIN first y ON y.n BETWEEN x.n AND x.n + 1 AND x.l <> y.l AND x.n >= 20
    AND (left(x.l, x.n // 2) = left(y.l, x.n // 2) OR right(x.l, x.n - x.n // 2) = right(y.l, x.n - x.n // 2))
), near AS (
  SELECT x, y, px, py FROM pair
  WHERE len(list_filter(range(1, n + 1), lambda i:
    left(x, i - 1) = left(y, i - 1) AND substr(x, i + 1 - more) = substr(y, i + 1))) > 0
    OR (more = 1 AND x = left(y, n))
), gone AS (
  SELECT DISTINCT CASE WHEN px < py THEN y ELSE x END AS l FROM near
), verdict AS (
  SELECT line.doc_id, line.pos, line.l, gone.l IS NOT NULL AS near,
         gone.l IS NULL AND first.place <> struct_pack(d := line.doc_id, a := line.pos) AS exact
  FROM line LEFT JOIN first ON first.l = line.l LEFT JOIN gone ON gone.l = line.l
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count_if(coalesce(exact, false)) AS n_exact, count_if(near) AS n_near,
         coalesce(string_agg(CASE WHEN NOT near AND NOT coalesce(exact, false) THEN l END, chr(10) ORDER BY pos), '')
           AS kept_text
  FROM verdict GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op2_line_dedup", OP2_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents
), pattern(kind, p) AS (VALUES
  (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9+/_-]+')
), cut AS (
  SELECT doc_id, kind, string_split(regexp_replace(text, '(' || p || ')', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM t, pattern WHERE regexp_matches(text, p)
), part AS (
  SELECT doc_id, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut
), placed AS (
  SELECT doc_id, kind, part, i, sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM part
), match AS (
  SELECT doc_id, kind, part, (stop - length(part))::INT AS start, stop::INT AS stop FROM placed WHERE i % 2 = 0
), base AS (
  SELECT * FROM match
  WHERE (kind = 0 AND length(regexp_extract(part, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
         AND NOT regexp_matches(part, '^[^:=]*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{0,11}$'))
     OR (kind = 1 AND length(part) >= 18) OR (kind = 2 AND length(part) >= 16)
), candidate AS (
  SELECT doc_id, part, start, stop FROM match
  WHERE kind = 3 AND length(part) >= 20
    AND NOT regexp_matches(part, '^[A-Z]?[a-z]+$|^[A-Z]+$|^[A-Za-z]+([-_/][A-Za-z]+)+$|^[0-9]+$')
    AND NOT regexp_matches(part, '(?i)0123456789|abcdefghij|qwertyuiop|example|placeholder|changeme|your[-_]?(api)?[-_]?key|xxxxxx')
    AND NOT regexp_matches(part, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND len(list_filter(range(1, length(part) - 4), lambda i: substr(part, i, 6) = repeat(substr(part, i, 1), 6))) = 0
), slid AS (
  SELECT DISTINCT part, unnest(range(1, length(part) - 18)) AS i FROM candidate
), letter AS (
  SELECT part, i, unnest(string_split(substr(part, i, 20), '')) AS c FROM slid
), counted AS (
  SELECT part, i, c, count(*) AS n FROM letter GROUP BY part, i, c
), entropy AS (
  SELECT part, max(bits) AS bits FROM (
    SELECT part, i, round(-sum(n / 20.0 * log2(n / 20.0)), 6) AS bits FROM counted GROUP BY part, i) GROUP BY part
), fresh AS (
  SELECT doc_id, 3 AS kind, part, start, stop FROM candidate JOIN entropy USING (part)
  WHERE bits >= CASE WHEN regexp_matches(part, '^[0-9a-fA-F]+$') THEN 3.0 WHEN regexp_matches(part, '^[A-Za-z]+$') THEN 4.1
                     WHEN regexp_matches(part, '^[A-Za-z0-9]+$') THEN 3.7 ELSE 3.9 END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = candidate.doc_id AND b.start < candidate.stop AND candidate.start < b.stop)
), span AS (
  SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END || ':' || start || ':' || stop AS s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM fresh)
), joined AS (
  SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
         string_agg(CASE WHEN kind < 3 THEN s END, ',' ORDER BY start, kind) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM span GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""


@query("op4_secrets", OP4_SQL)
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = secrets.joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.withColumn("contaminated", F.lit(True))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(documents(spark, sf_dir), support=1)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        texts = F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.array_join(texts, ",")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("term").alias("n_term"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


OP9_SQL = r"""
WITH name(licence, n) AS (VALUES
  ('MIT', 'the mit license'), ('Apache-2.0', 'the apache license version 2 0'), ('Apache-2.0', 'the apache license 2 0'),
  ('GPL-2.0', 'the gnu general public license version 2'), ('GPL-2.0', 'gpl 2 0'),
  ('GPL-3.0', 'the gnu general public license version 3'), ('GPL-3.0', 'gpl 3 0'),
  ('LGPL-3.0', 'the gnu lesser general public license version 3'),
  ('AGPL-3.0', 'the gnu affero general public license version 3'),
  ('MPL-2.0', 'the mozilla public license version 2 0'), ('MPL-2.0', 'the mozilla public license 2 0'),
  ('BSD-2-Clause', 'the bsd 2 clause license'), ('BSD-3-Clause', 'the bsd 3 clause license'),
  ('CC-BY-4.0', 'cc by 4 0'), ('CC-BY-4.0', 'the creative commons attribution 4 0 international license'),
  ('CC-BY-SA-4.0', 'cc by sa 4 0'), ('CC-BY-NC-4.0', 'cc by nc 4 0'), ('CC0-1.0', 'cc0 1 0')
), form(f) AS (VALUES ('licensed under '), ('released under '), ('distributed under '),
  ('this work is licensed under '), ('this software is licensed under '), ('this project is licensed under ')
), known AS (
  SELECT licence, sha256(f || n) AS digest FROM name, form
  UNION ALL SELECT * FROM (VALUES
    ('Apache-2.0', 'c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073'),
    ('BSD-2-Clause', 'a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30'),
    ('BSD-3-Clause', '9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2'),
    ('GPL-3.0', '3e0639e2a9692446a12737e1e8a22455de0cf05c81a22cf39ea6cc1d2e85581b'),
    ('ISC', '217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a'),
    ('MIT', '0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c'),
    ('MPL-2.0', '15d9d39b9899a45bf810a3418301f271cb5c1d7bd61153ec978c50af3b4546b2')
  )
), doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), unit AS (
  SELECT doc_id, true AS a, text AS u FROM doc
  UNION ALL SELECT doc_id, false, u FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS u FROM doc) WHERE u <> text
  UNION ALL SELECT doc_id, false, u FROM (SELECT doc_id, text, unnest(string_split_regex(text, '\n[ \t\r]*\n')) AS u FROM doc)
            WHERE u <> text AND contains(u, chr(10))
), plain AS (
  SELECT doc_id, a, trim(regexp_replace(regexp_replace(lower(u),
    '(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright[ \t]*)?(?:\(c\)|©)|copyright[ \t]+(?:[0-9]|by\b)|all rights reserved)[^\n]*$', ' ', 'g'),
    '[^\p{L}\p{N}]+', ' ', 'g')) AS u
  FROM unit
  WHERE contains(lower(u), 'licen') OR contains(lower(u), 'permission') OR contains(lower(u), 'redistribution')
     OR contains(lower(u), 'under ')
), spelled AS (
  SELECT doc_id, a,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u,
      '\blicence', 'license', 'g'), '\bsub license', 'sublicense', 'g'), '\bnon infringement\b', 'noninfringement', 'g'),
      '\bcopyright owner', 'copyright holder', 'g'), '\bcontributor s\b', 'contributors', 'g'), '\bhttp www\b', 'https www', 'g'),
      '\bmerchantibility\b', 'merchantability', 'g'), '\bper cent\b', 'percent', 'g'), '\bv ?([0-9])', 'version \1', 'g'),
      '\borganisation', 'organization', 'g'), '\bfavour', 'favor', 'g') AS u
  FROM plain
), hit AS (
  SELECT doc_id, a, licence FROM spelled JOIN known ON digest = sha256(u)
), found AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n_matches,
         string_agg(DISTINCT CASE WHEN a THEN licence END, ',' ORDER BY CASE WHEN a THEN licence END) AS whole
  FROM hit GROUP BY doc_id
)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_matches, 0) AS n_matches, coalesce(whole, '') AS whole
FROM documents LEFT JOIN found USING (doc_id)
"""


@query("op9_licenses", OP9_SQL)
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(documents(spark, sf_dir)).select(
        "doc_id", F.array_join("licences", ",").alias("licences"), "n_matches",
        F.array_join("whole", ",").alias("whole"),
    )


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~held_out()))
    return quality.score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(
        documents(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    )


@query("op13_jaccard_join")
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf_dir))
