"""Queries of the operators in this package and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    line_dedup,
    line_quality,
    merkle,
    mixing,
    multi_index,
    near_dedup,
    secret_scan,
    toxicity,
    url_templates,
    warc,
)
from prefspark.llm.labelled import labelled_sample, remainder
from prefspark.session import work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.scan(documents, secret_scan.fit(secret_scan.corpus_samples(documents)))
    base = F.filter("spans", lambda s: s.kind != secret_scan.MARKOV)

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secret_scan.KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[1]


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, learn = table(spark, sf_dir, "documents"), remainder("doc_id", 4) != 2
    labels = table(spark, sf_dir, "labels")
    sample = labelled_sample(documents, labels, "quality", learn, line_quality.TRAIN_ROWS, "text")
    return line_quality.score(documents, line_quality.fit(sample)).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= line_quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``documents`` by a model that learns from no document with remainder 0."""
    sample = labelled_sample(
        documents, labels, "toxic", remainder("doc_id", 5) != 0, toxicity.TRAIN_ROWS, "text", "lang"
    )
    return toxicity.score(documents, toxicity.fit(sample))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(spark, manifest, root, with_payload=False).drop("url")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", exact_dedup.sha256_of(F.col("kept_text")).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), lambda i: F.pmod(i, F.lit(100)) == 0)


def op12_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages")).drop("template")


def merkle_proofs(documents: DataFrame) -> DataFrame:
    """Proofs of documents, each folded again from the leaf of a text that every third document has in lower case."""

    def leaf(text):
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    forged = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    made = merkle.proofs(documents, leaf(F.col("text")), F.when(forged, leaf(line_dedup.ascii_lower(F.col("text")))))
    digests = [merkle.hex_of(F.col(name)).alias(name) for name in ("leaf", "subroot", "root")]
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("proof"))
    shown = made.select("doc_id", *digests, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_proofs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mix": op2_source_mix,
    "op3_line_quality": op3_line_quality,
    "op4_multi_index": op4_multi_index,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_templates": op12_url_templates,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _url_oracle() -> str:
    """The tree of path templates, level by level."""
    sums = ("n", "block", "allow", *url_templates.CLASSES)
    spread, last = repr(url_templates.SPREAD), url_templates.LEVELS - 1

    def far(own: str, n: str) -> str:
        rest = f"(all_{own} - {own})::DOUBLE / ({n.replace('@', 'all_')} - ({n.replace('@', '')}))"
        roots = f"1 / sqrt({n.replace('@', '')}) + 1 / sqrt({n.replace('@', 'all_')} - ({n.replace('@', '')}))"
        return f"abs({own}::DOUBLE / ({n.replace('@', '')}) - {rest}) > {spread} * ({roots})"

    labelled = "(@block + @allow)"
    own, everything = labelled.replace("@", ""), labelled.replace("@", "all_")
    differs = " OR ".join(far(c, "@n") for c in url_templates.CLASSES)
    differs += f" OR ({own} > 0 AND {everything} > {own} AND {far('block', labelled)})"
    steps = []
    for k in range(url_templates.LEVELS):
        classes = ", ".join(
            f"sum(CASE WHEN following = '{c}' THEN n ELSE 0 END) AS {c}" if c in url_templates.CLASSES else f"sum({c}) AS {c}"
            for c in sums
        )
        totals = ", ".join(f"sum({c}) OVER (PARTITION BY host, made) AS all_{c}" for c in sums)
        steps.append(f"""
        here{k} AS (
            SELECT *, segments[{k + 1}] AS segment, segments[{k + 2}] AS nxt,
                   CASE WHEN nxt IS NULL THEN 'stop' ELSE 'next_' || md5(nxt)[1] END AS following
            FROM leaves{k}),
        branches{k} AS (
            SELECT host, made, segment, {classes} FROM here{k} WHERE segment IS NOT NULL GROUP BY host, made, segment),
        nodes{k} AS (SELECT *, {totals} FROM branches{k}),
        kept{k} AS (
            SELECT host, made, segment FROM nodes{k}
            WHERE n >= {url_templates.SUPPORT} AND CASE WHEN all_n = n THEN TRUE ELSE {differs} END),
        leaves{k + 1} AS (
            SELECT h.host, h.template, h.segments, h.n, h.block, h.allow,
                   CASE WHEN h.segment IS NULL THEN h.made
                        ELSE h.made || '/' || CASE WHEN k.segment IS NULL THEN '*' ELSE h.segment END END AS made
            FROM here{k} h LEFT JOIN kept{k} k ON h.host = k.host AND h.made = k.made AND h.segment = k.segment)""")
    rules = sorted(url_templates.RULES, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        domain, _, prefix = rule.partition("/")
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{prefix}')"

    chosen = " ".join(f"WHEN {fits(text)} THEN '{text}'" for _, text in rules)
    says = " ".join(f"WHEN '{text}' THEN '{verdict}'" for verdict, text in rules)
    return rf"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
            SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut),
        ruled AS (SELECT *, CASE {chosen} END AS rule FROM split),
        parts AS (
            SELECT *, CASE rule {says} END AS says, string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') AS all_parts
            FROM ruled),
        folded AS (
            SELECT *, CASE WHEN len(all_parts) > {last}
                      THEN list_append(all_parts[1:{last}], array_to_string(all_parts[{last + 1}:], '/')) ELSE all_parts END AS few
            FROM parts),
        typed AS (
            SELECT page_id, host, path, rule, says, list_transform(few, lambda s: CASE
                       WHEN length(s) > {url_templates.LONG} THEN '{{long}}'
                       WHEN regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{{hex}}'
                       WHEN len(regexp_extract_all(s, '[0-9]+')) > 2 THEN '{{mixed}}'
                       ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS segments
            FROM folded),
        keyed AS (SELECT *, array_to_string(segments, '/') AS template FROM typed),
        leaves0 AS (
            SELECT host, template, CASE WHEN template = '' THEN [] ELSE any_value(segments) END AS segments, count(*) AS n,
                   count(*) FILTER (WHERE says = 'block') AS block, count(*) FILTER (WHERE says = 'allow') AS allow, '' AS made
            FROM keyed GROUP BY host, template),{",".join(steps)},
        prior AS (SELECT (sum(block) + 1)::DOUBLE / (sum(block + allow) + 2) AS share FROM leaves{last + 1}),
        judged AS (
            SELECT host, made, sum(block) AS b, sum(block + allow) AS labelled,
                   {url_templates.SMOOTHING}::DOUBLE + {url_templates.UNLABELLED}::DOUBLE * (sum(n) - sum(block + allow)) AS weight
            FROM leaves{last + 1} GROUP BY host, made),
        verdicts AS (
            SELECT host, made, CASE WHEN (b + weight * share) / (labelled + weight) >= {url_templates.PURITY}::DOUBLE
                                    THEN 'block' ELSE 'allow' END AS verdict
            FROM judged CROSS JOIN prior)
        SELECT page_id, host, path, rule, coalesce(says, verdict) AS verdict
        FROM keyed JOIN leaves{last + 1} USING (host, template) JOIN verdicts USING (host, made)
    """


def _merkle_oracle(levels: int = 7, upper: int = 3) -> str:
    """The trees level by level, for up to 8 ** ``levels`` documents of a language and 8 ** ``upper`` languages."""

    def climb(name: str, group: str, levels: int) -> list[str]:
        steps = []
        for k in range(levels):
            steps.append(f"""
        {name}s{k} AS (
            SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY {group}, pos // 8 ORDER BY pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY {group}, pos // 8 ORDER BY pos
                          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name}{k}),
        {name}{k + 1} AS (
            SELECT {group}, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
                   CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
            FROM {name}{k} GROUP BY {group}, pos // 8)""")
        return steps

    def fold(before: str, after: str, level: str, on: str) -> str:
        return f"""
        {after} AS (
            SELECT p.row_id, p.tree, p.at // 8 AS at,
                   CASE WHEN s.n > 1 THEN sha256(s.l || p.folded || s.r) ELSE p.folded END AS folded,
                   p.proof || CASE WHEN s.n > 1 THEN s.l || s.r ELSE '' END AS proof
            FROM {before} p JOIN {level} s ON {on} AND s.pos = p.at)"""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                    lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""
    paths = [fold(f"p{k}", f"p{k + 1}", f"ts{k}", "s.tree = p.tree") for k in range(levels)]
    rise = [fold(f"q{k}", f"q{k + 1}", f"us{k}", "s.top = 0") for k in range(upper)]
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS row_id, doc_id, lang, {leaf("text")} AS leaf,
                   CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS tampered
            FROM documents),
        numbered AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n
            FROM texts),
        t0 AS (SELECT tree, pos, n, leaf AS digest FROM numbered),{",".join(climb("t", "tree", levels))},
        u0 AS (SELECT 0 AS top, tree AS pos, count(*) OVER () AS n, digest FROM t{levels}),{",".join(climb("u", "top", upper))},
        p0 AS (SELECT row_id, tree, pos AS at, tampered AS folded, '' AS proof FROM numbered),{",".join(paths)},
        q0 AS (SELECT row_id, tree, tree AS at, folded, proof FROM p{levels}),{",".join(rise)}
        SELECT doc_id, leaf, t.digest AS subroot, u.digest AS root, sha256(q.proof) AS proof_sha256,
               q.folded AS folded_root, q.folded = u.digest AS verified
        FROM numbered JOIN q{upper} q USING (row_id) JOIN t{levels} t ON t.tree = numbered.tree CROSS JOIN u{upper} u
    """


ORACLES = {
    "op11_hard_negatives": """
        WITH usable AS (
            SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        numbered AS (SELECT row_number() OVER () AS row_id, * FROM usable),
        scored AS (
            SELECT a.row_id AS anchor, a.id AS anchor_id, b.row_id, b.id, a.label = b.label AS alike,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM numbered a JOIN numbered b ON a.id % 100 = 0 AND a.row_id <> b.row_id),
        positives AS (
            SELECT * FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
        ranked AS (
            SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor, p.row_id ORDER BY n.score DESC, n.id)::INTEGER AS rank
            FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike
                 AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op12_url_templates": _url_oracle(),
    "op13_merkle_manifest": _merkle_oracle(),
    "op2_source_mix": r"""
        WITH sized AS (
            SELECT row_number() OVER () AS row_id, doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) AS rank
            FROM sized GROUP BY source),
        weighed AS (
            SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap
            FROM sources),
        levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE
                      / sum(weight) OVER onward AS level
            FROM weighed
            WINDOW earlier AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   onward AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        targets AS (
            SELECT source, rank, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
        shuffled AS (
            SELECT row_id, t.rank, size, t.source_size, t.target,
                   sum(size) OVER (PARTITION BY t.rank
                                   ORDER BY md5('11:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size, row_id
                                   ROWS UNBOUNDED PRECEDING) AS words
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
            WHERE size > 0),
        items AS (
            SELECT row_id, rank, repeat, size,
                   (repeat * source_size + words - size / 2)::DOUBLE / target AS finish
            FROM shuffled, (VALUES (0), (1), (2)) AS r(repeat)),
        cut AS (
            SELECT row_id, size, sum(size) OVER (ORDER BY finish, rank, repeat ROWS UNBOUNDED PRECEDING) AS position
            FROM items),
        taken AS (
            SELECT row_id, sum(size) AS taken FROM cut
            WHERE position <= (SELECT sum(size) FROM sized) GROUP BY row_id)
        SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k USING (row_id)
    """,
    "op7_warc": """
        WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        placed AS (
            SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keeper
            FROM bodies),
        groups AS (
            SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS twenty_bits
            FROM placed)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((twenty_bits[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
        FROM groups
    """,
    "op8_exact_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        placed AS (
            SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id,
                   count(*) OVER (PARTITION BY text) AS group_size,
                   row_number() OVER (PARTITION BY text, doc_id) AS copy
            FROM texts)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept,
               sha256(text) AS text_sha256
        FROM placed
    """,
    "op9_line_dedup": r"""
        WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT row_id, doc_id, string_split(text, chr(10)) AS lines FROM texts),
        lines AS (
            SELECT row_id, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        common AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT k.row_id, k.doc_id, k.pos, k.line,
                   c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS dropped
            FROM keyed k LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY row_id, doc_id
    """,
    "op10_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
            FROM words),
        classes AS (
            SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS rep
            FROM sets),
        members AS (SELECT DISTINCT rep, n, unnest(s) AS shingle FROM classes WHERE doc_id = rep),
        shared AS (
            SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
            FROM members a JOIN members b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT a AS node, b AS other FROM edges
            UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
        least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
        SELECT doc_id, n AS n_shingles, coalesce(least(rep, other), rep) AS component_id,
               doc_id = coalesce(least(rep, other), rep) AS kept
        FROM classes LEFT JOIN least ON rep = node
    """,
}
