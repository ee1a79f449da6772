"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm import bpe, exact_dedup, hmm, imatch, license_scan, line_dedup, packing, pii, prefix_trie, quality, sharding, simhash, vector_codes
from draftmill.llm.common import save, table, text_of, with_row

Query = Callable[[SparkSession, str], DataFrame]

#: Byte limit of a shard in the registered query.
SHARD_BYTES = 1 << 20
#: A line on more than this share of a site's pages is boilerplate.
BOILERPLATE_RATIO = 0.3
#: Conversations of so many successive ids share their first turns, as many as a checksum modulo the other tells.
CONVERSATION_GROUP, CONVERSATION_HEADS = 5, 9


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return sharding.extendible_shards(docs, F.col("doc_id"), F.col("n_bytes"), SHARD_BYTES)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, cols = pii.find_spans(docs, pii.judge(docs))
    base = F.col(cols["base"])
    counts = [_count(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col(cols["all"])).alias("spans"))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, row = with_row(table(spark, sf_dir, "documents").select("doc_id", "text"))
    groups = exact_dedup.exact_groups(docs, row)
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = line_dedup.drop_site_boilerplate(pages, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")), BOILERPLATE_RATIO)
    return out.select("page_id", "host", "n_lines", "n_dropped", "clean_text")


def byte_bpe() -> Callable[[], packing.Encoder]:
    return packing.byte_bpe_encoder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


def op11_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = save(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "conversations")
    conv = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.rebuilt(convs, conv - conv % CONVERSATION_GROUP, F.crc32(conv.cast("string").cast("binary")) % CONVERSATION_HEADS))


def _op1_sql() -> str:
    return f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS INTEGER)), 16, '0') AS bits
  FROM documents),
nodes AS (
  SELECT n AS depth, substr(bits, 1, CAST(n AS INTEGER)) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM d, range(0, 17) AS r(n) GROUP BY 1, 2)
SELECT d.doc_id, d.n_bytes, n.shard, CAST(n.depth AS INTEGER) AS depth, n.shard_bytes, n.shard_rows
FROM d JOIN nodes n ON substr(d.bits, 1, CAST(n.depth AS INTEGER)) = n.shard
WHERE n.shard_bytes <= {SHARD_BYTES} OR n.shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY n.depth) = 1"""


def _op2_sql() -> str:
    chains, most = imatch.CHAINS, imatch.MOST_LEVELS
    pairs = range(len(imatch.MIXERS))
    depth = lambda bits: f"{most} - CASE WHEN {bits} > 0 THEN length(bin({bits})) ELSE 0 END"
    depths = ", ".join(f"{depth(f'y{c}')}, {depth(f'({imatch.MOST_BITS} - y{c})')}" for c in pairs)
    mixed = ", ".join(f"((name & 2147483647) * {imatch.MIXERS[c]} >> 17) & {imatch.MOST_BITS} AS y{c}" for c in pairs)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
lv AS (SELECT greatest(1, least({most}, CAST(ceil(log2(max(n) / 2.0e0 + 1)) AS INT))) AS levels FROM d),
nx AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v AS (
  SELECT doc_id, 1 AS of, text AS x FROM nx UNION ALL
  SELECT doc_id, 2, left(text, n - n // 4) || left(next_text, n // 4) FROM nx),
t AS (SELECT doc_id, of, unnest(list_distinct(list_filter(regexp_split_to_array(lower(x), '{imatch.TERM_BREAK}'), lambda w: w <> ''))) AS term FROM v),
once AS (SELECT DISTINCT text FROM d),
ot AS (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '{imatch.TERM_BREAK}'), lambda w: w <> ''))) AS term FROM once),
freq AS (SELECT term, count(*) AS df FROM ot GROUP BY term),
terms AS (SELECT DISTINCT term FROM t),
hashed AS (SELECT term, CAST('0x' || substr(sha256(term), 1, 8) AS BIGINT) AS name FROM terms),
mixed AS (SELECT term, name, {mixed} FROM hashed),
deep AS (SELECT term, name, [{depths}] AS depths FROM mixed),
known AS (
  SELECT doc_id, of, name, depths, coalesce(df, 0) < {imatch.LEAST_SHARE}e0 * (SELECT count(*) FROM once) AS rare,
         coalesce(df >= {imatch.LEAST_SHARE}e0 * (SELECT count(*) FROM once) AND df <= {imatch.MOST_SHARE}e0 * (SELECT count(*) FROM once), false) AS in_band
  FROM t JOIN deep USING (term) LEFT JOIN freq USING (term)),
marked AS (SELECT *, bool_or(in_band) OVER (PARTITION BY doc_id, of) AS any_band FROM known),
inb AS (
  SELECT DISTINCT doc_id, of, name, depths, false AS rare FROM marked WHERE in_band OR NOT any_band UNION ALL
  SELECT DISTINCT doc_id, of, name, depths, true FROM marked WHERE rare),
whole AS (SELECT doc_id, of, substr(md5(string_agg(CAST(name AS VARCHAR), ' ' ORDER BY name)), 1, 8) AS s FROM inb WHERE NOT rare GROUP BY 1, 2),
kept AS (
  SELECT doc_id, of, c, l, CASE WHEN count(*) > 2 THEN '+' ELSE substr(md5(string_agg(CAST(name AS VARCHAR), ' ' ORDER BY name)), 1, 8) END AS s
  FROM inb, range(1, {chains + 1}) AS rc(c), range(1, {most + 1}) AS rl(l) WHERE depths[c] >= l AND l <= (SELECT levels FROM lv) AND rare = (c > {chains - 2 * imatch.RARE_PAIRS}) GROUP BY 1, 2, 3, 4),
slot AS (
  SELECT v.doc_id, v.of, 0 AS k, coalesce(whole.s, '') AS s FROM v LEFT JOIN whole USING (doc_id, of) UNION ALL
  SELECT v.doc_id, v.of, (c - 1) * {most} + l, coalesce(kept.s, '') FROM v CROSS JOIN range(1, {chains + 1}) AS rc(c) CROSS JOIN range(1, {most + 1}) AS rl(l) LEFT JOIN kept USING (doc_id, of, c, l)
  WHERE l <= (SELECT levels FROM lv)),
fp AS (SELECT doc_id, of, string_agg(s, '-' ORDER BY k) AS f FROM slot GROUP BY 1, 2),
pairs AS (
  SELECT doc_id, 'e' AS what, doc_id AS other, 2 AS other_of FROM nx UNION ALL
  SELECT doc_id, 'n', next_id, 1 FROM nx),
near AS (
  SELECT p.doc_id, p.what, count(*) FILTER (length(a.s) = 8 OR length(b.s) = 8) AS used, count(*) FILTER (length(a.s) = 8 AND a.s = b.s) AS same
  FROM pairs p JOIN slot a ON a.doc_id = p.doc_id AND a.of = 1 JOIN slot b ON b.doc_id = p.other AND b.of = p.other_of AND b.k = a.k GROUP BY 1, 2)
SELECT nx.doc_id, nx.n AS n_chars, sha256(left(text, n - n // 4) || left(next_text, n // 4)) AS edited_sha256, f1.f AS fingerprint, f2.f AS edited_fingerprint,
       CASE WHEN e.used > 0 THEN CAST(e.same AS DOUBLE) / e.used WHEN f1.f = f2.f THEN 1e0 ELSE 0e0 END AS near_edited,
       CASE WHEN m.used > 0 THEN CAST(m.same AS DOUBLE) / m.used WHEN f1.f = f3.f THEN 1e0 ELSE 0e0 END AS near_next
FROM nx JOIN fp f1 ON f1.doc_id = nx.doc_id AND f1.of = 1 JOIN fp f2 ON f2.doc_id = nx.doc_id AND f2.of = 2 JOIN fp f3 ON f3.doc_id = nx.next_id AND f3.of = 1
JOIN near e ON e.doc_id = nx.doc_id AND e.what = 'e' JOIN near m ON m.doc_id = nx.doc_id AND m.what = 'n'"""


def _op6_sql() -> str:
    scanner, rows = license_scan.Scanner(), []
    for k, (name, words, grams) in enumerate(scanner.rows):
        rows.append(f"({k}, '{name}', {words}, [{', '.join(repr(g) for g in grams)}], {scanner.need[k]})")
    return f"""
WITH t(k, license, n, g, need) AS (VALUES {', '.join(rows)}),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, len(w) AS m, list_transform(w[1:len(w) - 1], lambda a, i: a || ' ' || w[i + 1]) AS b FROM words WHERE len(w) > 1),
able AS (SELECT doc_id, k, license, g, b, least(n, m) - 1 AS width FROM grams JOIN t ON len(list_intersect(b, g)) >= need),
windows AS (SELECT doc_id, k, license, g, b, width, unnest(range(0, len(b) - width + 1)) AS p FROM able),
sized AS (SELECT doc_id, k, license, p, g, list_distinct(b[p + 1:p + width]) AS d FROM windows),
scored AS (SELECT doc_id, k, license, p, 2.0e0 * len(list_intersect(d, g)) / (len(d) + len(g)) AS dice FROM sized),
best AS (SELECT * FROM scored WHERE dice >= {license_scan.THRESHOLD}e0 QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, p) = 1),
hits AS (
  SELECT doc_id, count(*) AS n_matches, first(license ORDER BY dice DESC, p, license) AS license, max(dice) AS dice,
         first(p ORDER BY dice DESC, p, license) AS word_no, string_agg(p || ':' || license, ',' ORDER BY p, license, dice DESC) AS matches
  FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(h.n_matches, 0) AS n_matches, h.license, round(h.dice, 6) AS dice, CAST(h.word_no AS BIGINT) AS word_no, coalesce(h.matches, '') AS matches
FROM documents d LEFT JOIN hits h USING (doc_id)"""


def _op7_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


def _op8_sql() -> str:
    clean = "line"
    for entity, char in line_dedup.ENTITIES:
        clean = f"replace({clean}, '{entity}', chr({ord(char)}))"
    return rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST_PATTERN}', 1)) AS host,
         list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '{line_dedup.INLINE_PATTERN}', '', 'g'), '{line_dedup.BREAK_PATTERN}'), lambda line: trim({clean})), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY 1, 2),
often AS (
  SELECT host, list(line) AS bad FROM seen JOIN totals USING (host)
  WHERE n >= {line_dedup.LEAST_PAGES} AND n > {BOILERPLATE_RATIO}e0 * pages GROUP BY host),
kept AS (
  SELECT page_id, p.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS k
  FROM p LEFT JOIN often USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(k) AS BIGINT) AS n_dropped, coalesce(array_to_string(k, chr(10)), '') AS clean_text FROM kept"""


def _op12_sql() -> str:
    parts, last = vector_codes.PARTS, vector_codes.ROUNDS
    rounds = []
    for k in range(last + 1):
        rounds.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, p, q.v, arg_min(e, list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, b.v) + list_inner_product(b.v, b.v) ORDER BY e) AS e,
         min(list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, b.v) + list_inner_product(b.v, b.v)) AS d
  FROM part q JOIN book{k} b USING (p) GROUP BY 1, 2, 3)""".replace("arg_min(e, ", "first(e ORDER BY ").replace(" ORDER BY e) AS e", ", e) AS e"))
        if k < last:
            rounds.append(f"""
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, floor(sum(v[i]) / count(*)) AS m FROM near{k}, range(1, 1 + len(v)) AS r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {vector_codes.SCALE}) AS DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, c[p * len(c) // {parts} + 1:(p + 1) * len(c) // {parts}] AS v FROM kept, range({parts}) AS r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part QUALIFY e < {vector_codes.ENTRIES}),{','.join(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


def _op13_sql() -> str:
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST) AS l FROM turns GROUP BY 1),
bits(c, s, rest, k) AS (
  SELECT c, 4294967295::BIGINT, CAST(c AS VARCHAR), 0 FROM own UNION ALL
  SELECT c, CASE WHEN k > 0 THEN xor(s >> 1, CASE WHEN s % 2 = 1 THEN 3988292384 ELSE 0 END) ELSE xor(s, ascii(rest)) END,
         CASE WHEN k = 8 THEN rest[2:] ELSE rest END, (k + 1) % 9 FROM bits WHERE rest <> ''),
heads AS (SELECT c, CAST(xor(s, 4294967295) % {CONVERSATION_HEADS} AS INT) AS h FROM bits WHERE rest = ''),
built AS (
  SELECT o.c, list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) AS l
  FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % {CONVERSATION_GROUP}),
steps AS (
  SELECT c, d, len(l) AS n, l[d] AS last, sha256(to_json(l[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(to_json(l[1:d - 1])::VARCHAR) END AS above
  FROM built, range(0, 1 + len(l)) AS r(d)),
nodes AS (
  SELECT node, any_value(above) AS above, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(coalesce(strlen(last.t), 0)) AS own_saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM steps GROUP BY node),
fan AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY 1),
up(node, top) AS (SELECT node, node FROM nodes UNION ALL SELECT up.node, n.above FROM up JOIN nodes n ON n.node = up.top WHERE n.above IS NOT NULL),
sums AS (
  SELECT top, CAST(sum(own_saved) AS BIGINT) AS saved_tokens, count(*) FILTER (fan.n IS NULL) AS n_leaves
  FROM up JOIN nodes ON nodes.node = up.node LEFT JOIN fan ON fan.node = up.node GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(fan.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.above LEFT JOIN fan ON fan.node = n.node JOIN sums ON sums.top = n.node"""


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_imatch": op2_imatch,
        "op3_pii": op3_pii,
        "op4_simhash": op4_simhash,
        "op5_bpe": op5_bpe,
        "op6_license_scan": op6_license_scan,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_packing": op9_packing,
        "op10_quality": op10_quality,
        "op11_hmm_score": op11_hmm_score,
        "op12_vector_codes": op12_vector_codes,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _op1_sql(), "op2_imatch": _op2_sql(), "op6_license_scan": _op6_sql(), "op7_exact_dedup": _op7_sql(), "op8_line_dedup": _op8_sql(), "op12_vector_codes": _op12_sql(), "op13_prefix_trie": _op13_sql()}
