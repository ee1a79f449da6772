"""Each operator against brute force on small tables, and on tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from draftmill.llm import bpe, common, exact_dedup, imatch, license_scan, line_dedup, packing, pii, quality, sharding, simhash
from draftmill.llm.catalog import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string, score double, rest int, row string, n int"
WORDS = "the of and ing tion thor esh ble ndle was for inth ore lin her ous wh edst cra que".split()


def prose(rng, n):
    return " ".join(WORDS[i] + (WORDS[j] if j % 3 else "") for i, j in rng.integers(0, len(WORDS), (n, 2)))


def messy_rows():
    rng = np.random.default_rng(3)
    base = prose(rng, 200)
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "two words",
        base,
        base,
        base.replace(" ", "\n"),
        base + " more",
        "mail a.b@c.de or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.0.0.255.",
        "É ß 😀 日本語 <|endoftext|> İ Σ",
        "x" * 3000,
        prose(rng, 6000),
        "Released under the MIT License.",
        "intro to a page of some more words than its notices\nReleased under the MIT license!\nThis work is licensed under the GNU General Public License, version 3.",
    ] + [prose(rng, int(k)) for k in rng.integers(1, 400, 25)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, base), (None, base), (None, None), (9, texts[9])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return messy_rows()


@pytest.fixture(scope="module")
def messy(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame([(k, t, None, "src", None, "s", "f", 0.5, 1, "r", 2) for k, t in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------- sharding


def leaf(bits, rows, limit):
    for d in range(len(bits) + 1):
        same = [n for b, n in rows if b[:d] == bits[:d]]
        if sum(same) <= limit or len(same) == 1:
            return bits[:d], d, sum(same), len(same)
    return None


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_shards_match_a_directory_built_row_by_row(spark, limit):
    rng = np.random.default_rng(1)
    rows = [(i, int(s)) for i, s in enumerate(rng.integers(0, 60, 300))]
    df = spark.createDataFrame(rows, "k long, size long")
    got = {r.k: (r.shard, r.depth, r.shard_bytes, r.shard_rows) for r in sharding.extendible_shards(df, F.col("k"), F.col("size"), limit).collect()}
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest(), 16))[2:].zfill(128)[:48] for k, _ in rows}
    table = [(bits[k], n) for k, n in rows]
    assert got == {k: leaf(bits[k], table, limit) for k, _ in rows}
    if limit < 10**9:
        assert len({v[0] for v in got.values()}) > 1


def test_shards_of_one_key_overflow_within_the_limit(spark):
    df = spark.createDataFrame([("hot", 7)] * 200 + [("hot", 90), ("cold", 5), (None, None)], "k string, size long")
    out = sharding.extendible_shards(df, F.col("k"), F.col("size"), 50).collect()
    assert len(out) == 203
    total = defaultdict(int)
    for r in out:
        total[r.shard] += r["size"] or 0
    for r in out:
        assert r.shard_bytes == total[r.shard] and (r.shard_bytes <= 50 or r.shard_rows == 1)
    assert len(total) < 80


def test_shards_of_messy_and_empty_tables(messy, empty, tmp_path, spark):
    out = sharding.extendible_shards(messy, F.col("doc_id"), F.octet_length("text"), 4000)
    assert out.count() == messy.count() and Counter(out.columns) == Counter({*messy.columns, "shard", "depth", "shard_bytes", "shard_rows"})
    sharding.write_shards(out.where("depth > 0"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == out.where("depth > 0").count()
    assert sharding.extendible_shards(empty, F.col("doc_id"), F.lit(1), 10).count() == 0


# -------------------------------------------------------------------- i-match


def test_imatch_contract(messy, empty, rows):
    out = imatch.fingerprints(messy).collect()
    assert len(out) == len(rows) and imatch.fingerprints(empty).count() == 0
    by_id = defaultdict(set)
    for k, t in rows:
        by_id[k].add(t or "")
    order = sorted(by_id, key=lambda k: (k is not None, k or 0))
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    want = Counter()
    for k, t in rows:
        t = t or ""
        q = len(t) // 4
        needed = max(len(x) // 4 for x in by_id[k])
        prefix = min(x[:needed] for x in by_id[after[k]])
        want[k, len(t), hashlib.sha256((t[: len(t) - q] + prefix[:q]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    same = defaultdict(set)
    for r in out:
        if r.n_chars == len(rows[5][1]):
            same[r.n_chars].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) <= 2 for v in same.values())  # equal texts, and the one with other white space


def test_imatch_likeness(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 150)) for _ in range(300)]
    out = imatch.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert out.e > 0.3 and out.n < 0.05


def test_imatch_of_a_large_group_of_copies(spark):
    """A group of copies that holds a third of all rows keeps its terms in the band, and so do others that share them."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{x}" for x in range(2000)]
    hot = " ".join(rng.choice(vocabulary, 200))
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(200)] + [hot] * 100
    out = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({out[k].fingerprint for k in range(200, 300)}) == 1
    assert out[210].near_next == 1 and 0.15 < out[210].near_edited <= 1
    assert 0.15 < out[299].near_edited < 1  # edited with another text


def test_imatch_levels_follow_the_longest_text(spark):
    """Long texts, and those without a term of the band, have comparable slots."""
    rng = np.random.default_rng(8)
    long = [f"t{x}" for x in range(6000)]
    texts = [" ".join(rng.permutation(long)) for _ in range(3)] + [" ".join(f"u{k}x{j}" for j in range(300)) for k in range(300)]
    out = imatch.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        slots = r.fingerprint.split("-")
        assert sum(len(x) == 8 for x in slots[1:]) >= imatch.CHAINS / 2
        assert 0 < r.near_edited < 1 or r.doc_id < 2  # the first texts hold the same terms


@pytest.mark.parametrize("most", [1000, 0])
def test_imatch_shuffles_only_texts_with_copies(spark, tmp_path, monkeypatch, most):
    """Each text once; a text without copies stays in the partition where it was read."""
    monkeypatch.setattr(imatch, "BROADCAST_REPEATS", most)
    texts = [f"text {k} " + "x" * 50 for k in range(200)] + ["copy a"] * 30 + ["copy b"] * 2 + [""] * 3
    path = str(tmp_path / "t")
    spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).write.parquet(path)
    once = imatch.distinct_texts(spark.read.parquet(path))
    assert sorted(r.t for r in once.collect()) == sorted(set(texts))
    assert sum("LeftAnti" in x for x in once._jdf.queryExecution().sparkPlan().toString().splitlines()) == (1 if most else 0)
    assert imatch.lexicon(spark.read.parquet(path), "t", least=0.0, most=1.0)[0].count() == len({w for t in texts for w in t.split()})


def test_exact_stream_has_the_callers_partitions(spark, tmp_path):
    """A stream's state has the partitions that the caller set, and not the default 200 of a new session, and no store stays loaded."""
    spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert exact_dedup.dedup_exact(spark.read.parquet(str(tmp_path / "d"))).count() == 7
    own = exact_dedup._stream_session(spark)
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert own.conf.get("spark.sql.streaming.stateStore.unloadOnCommit") == "true"


def test_imatch_many_null_ids(spark):
    rows = [(None, f"alpha beta {k}") for k in range(40)] + [(k, f"gamma {k}") for k in range(10)]
    assert imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == 50


# ------------------------------------------------------------------------ pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok[kind](m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


@pytest.fixture(scope="module")
def model(spark):
    return pii.judge(spark.createDataFrame([(t,) for _, t in messy_rows()], "text string"))


def test_pii_base_spans(spark, model, rows):
    rng = np.random.default_rng(9)
    bits = ["1", "2", "0", "255", "9", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "%", "\n", "é", "😀", "4111 1111 1111 1111", "+1 (743) 555-3824"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 40)))) for _ in range(800)] + [t or "" for _, t in rows]
    texts += ["1" * 5000, "a" * 5000, "1 " * 3000, ".1" * 3000, "a@b" * 2000, "+1(" * 2000]
    found, cols = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model)
    for r in found.select("i", pii.joined(F.col(cols["base"])).alias("b"), pii.joined(F.col(cols["all"])).alias("a")).collect():
        assert r.b == base(texts[r.i]), texts[r.i][:200]
        assert set(filter(None, r.b.split(","))) <= set(r.a.split(","))


def test_pii_long_runs_take_linear_time(spark, model):
    texts = ["a" * 300_000, "1" * 100_000, "a." * 100_000, "a@" * 50_000, "a@b.de " * 10_000, "1 2 3 4 " * 20_000]
    found, cols = pii.find_spans(spark.createDataFrame([(t,) for t in texts], "text string"), model)
    assert [r.n for r in found.select(F.size(cols["base"]).alias("n")).collect()] == [0, 0, 0, 0, 10_000, 0]


def test_pii_adds_spelled_out_data_and_redacts(spark, model):
    rows = [("please mail joe31 [at] uni-x4 [dot] org today",), ("call (743) 555-3824 now",), ("order 4785380592391138 came",), (None,), ("write a@b.de, +1 743 555 3824.",), ("x (555) 123-4567 (555) 987-6543 y",), ("x 555-123-4567 4111 1111 1111 1111 y",), ("lay fe80:12::9a3:4 or 10 . 0 . 0 . 255",)]
    out = [r.text for r in pii.redact(spark.createDataFrame(rows, "text string"), model).collect()]
    assert out[0] == "please mail [EMAIL] today" and "[PHONE]" in out[1] and out[2] == rows[2][0] and out[3] is None
    assert out[4] == "write [EMAIL], [PHONE]." and out[5] == "x [PHONE] [PHONE] y" and "[CARD]" in out[6] and out[7] == "lay [IP] or [IP]"


def test_pii_judge_is_calibrated(model):
    assert set(model.thresholds) == set(pii.KINDS) and all(0.5 <= t <= 0.995 for t in model.thresholds.values()) and model.slope > 0
    for kind, (precision, recall, n) in model.report.items():
        assert n > 10 and precision > 0.9 and recall > 0.5, (kind, precision, recall)


def plain_features(kind, m, before, after):
    d, groups = re.sub("[^0-9]", "", m), re.findall("[0-9]+", m)
    cues = [float(bool(re.search(c, before))) for c in pii.CUES.values()]
    return [
        pii.KINDS.index(kind), len(m), len(d), len(groups), max(map(len, groups), default=0), len(re.findall("[ -]", m)), m.count("."), m.count("/"), len(re.findall("[()]", m)), len(re.findall("[A-Za-z]", m)), len(set(d)),
        float(12 <= len(d) <= 19 and luhn(d)), max((int(g[:6]) for g in groups), default=0), int(d[0]) if d else -1, *cues,
        float(bool(re.search(r"[\w.,/:=$€#-]$", before)) and before[-1] != "_"), float(bool(re.search(r"^[^\W_]|^[%/:=-]|^[.,][0-9]", after))), float(bool(re.search(r"(?i)[\[({] ?(?:at|dot)| dot ", m))),
    ]


def plain_probability(model, f):
    margin = 0.0
    for weight, node in model.trees:
        while not isinstance(node, float):
            at, most, low, high = node
            node = low if f[at] <= most else high
        margin += weight * node
    return 1 / (1 + np.exp(-(margin * model.slope + model.offset)))


def plain_proposals(text, generator):
    for c in re.finditer(pii.GENERATORS[generator], text):
        if generator != "digits":
            yield [(c.start(), c.end())]
            continue
        groups, out = [(g.start(), g.end()) for g in re.finditer("[0-9]+", c.group())], []
        for i, (b, _) in enumerate(groups):
            for _, e in groups[i : i + pii.GROUPS]:
                inside = c.group()[b:e]
                if pii.LEAST_DIGITS <= len(re.sub("[^0-9]", "", inside)) <= pii.MOST_DIGITS and e - b <= pii.MOST_LENGTH:
                    opened = b > 0 and c.group()[b - 1] == "(" and ")" in inside
                    out.append((c.start() + b - opened, c.start() + e))
        yield out


def plain_spans(text, model):
    """All spans, by a walk over the trees."""
    fixed = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base(text).split(",") if x)]
    added = {}
    for generator, kinds in pii.PROPOSES.items():
        added[generator] = []
        for cluster in plain_proposals(text, generator):
            good = []
            for a, b in cluster:
                if any(x < b and a < y for x, y, _ in fixed):
                    continue
                p = {k: plain_probability(model, plain_features(k, text[a:b], text[max(0, a - pii.CONTEXT) : a], text[b : b + pii.CONTEXT])) for k in kinds}
                k = max(kinds, key=lambda k: (p[k] - model.thresholds[k], p[k], -pii.KINDS.index(k)))
                if p[k] >= model.thresholds[k]:
                    good.append((-p[k], a - b, a, b, k))
            chosen = []
            for _, _, a, b, k in sorted(good):
                if all(b <= x or y <= a for x, y, _ in chosen):
                    chosen.append((a, b, k))
            added[generator] += chosen
    others = added["mail"] + added["net"]
    beside = [s for s in added["digits"] if all(s[1] <= x or y <= s[0] for x, y, _ in others)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, pii.KINDS.index(k), k, b) for a, b, k in fixed + others + beside))


def test_pii_spans_are_those_of_a_plain_walk(spark, model, rows):
    rng = np.random.default_rng(15)
    bits = ["(743) 555-3824", "743.555.3824", "4111.1111.1111.1111", "joe [at] x [dot] org", " at home.it", "10 . 0 . 0 . 1", "fe80::1:2", "2024-01-15 10.22", "978-1-23-456789-0", "4111 1111 1111 1111", "+1 (743) 555-3824", "12", "345", " ", " ", "-", ".", "(", ")", "/", "call", "é", "no ", "#", "a@b.de", "8675309"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 12)))) for _ in range(400)] + [t or "" for _, t in rows]
    found, cols = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model)
    got = {r.i: r.a for r in found.select("i", pii.joined(F.col(cols["all"])).alias("a")).collect()}
    assert [texts[i] for i in got if got[i] != plain_spans(texts[i], model)] == []
    assert sum(len(got[i].split(",")) for i in got) > sum(len(base(t).split(",")) for t in texts)


def test_pii_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 5000):
        x = list(range(n))
        assert spark.range(1).select(pii.running(F.array(*map(F.lit, x)).cast("array<int>") if n < 300 else F.sequence(F.lit(0), F.lit(n - 1))).alias("r")).first().r == list(np.cumsum(x))


# -------------------------------------------------------------------- simhash


def brute_components(fps):
    names = sorted(set(fps))
    parent = {f: f for f in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in names}


def fingerprint(t):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_contract(messy, empty, rows):
    out = simhash.near_duplicates(messy).collect()
    fp = [(k, fingerprint(t)) for k, t in rows]
    comp = brute_components([f for _, f in fp])
    least = {}
    for k, f in fp:
        if k is not None:
            least[comp[f]] = min(least.get(comp[f], k), k)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out) == Counter((k, f, least.get(comp[f])) for k, f in fp)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.dedup_near(messy)
    assert kept.columns == messy.columns and kept.count() == len(set(comp.values()))


@pytest.mark.parametrize(("bucket", "chunk", "pays"), [(8, 1 << 16, 0.5), (8, 40, 0.5), (8, 40, 0.0), (8, 40, 9.0), (4096, 1 << 16, 0.5)])
def test_links_connect_all_that_is_near(spark, monkeypatch, bucket, chunk, pays):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "PAYS", pays)  # 0: only chunks; 9: parted as long as bits are left
    if chunk == 40:
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    rng = np.random.default_rng(bucket)
    fps = {int(x) for x in rng.integers(0, 2**63, 300)} | {0, 2**64 - 1}
    center = int(rng.integers(0, 2**63))
    for _ in range(250):  # near copies of one text
        x = center
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(fps)
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(f)
    for members in groups.values():
        assert len({got.get(f, f) for f in members}) == 1
    assert len({got.get(f, f) for f in fps}) == len(groups)


def test_dense_buckets_are_not_multiplied(spark, monkeypatch):
    """Near copies of one text: their rows stay near one a probe, however large the group."""
    rng = np.random.default_rng(4)
    center, fps = int(rng.integers(0, 2**63)), set()
    while len(fps) < 6000:
        x = center
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    saved = {}
    monkeypatch.setattr(simhash, "BUCKET", 256)
    monkeypatch.setattr(simhash, "save", lambda df, label: saved.setdefault(f"{label}{len(saved)}", common.save(df, label)))
    found = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"))
    assert max([t.count() for k, t in saved.items() if k.startswith("simhash-narrow")], default=0) <= 16 * len(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in found.collect():
        parent[root(r.a % 2**64)] = root(r.b % 2**64)
    every = np.array(sorted(fps), np.uint64)
    for k, x in enumerate(every):
        for y in every[k + 1 :][np.bitwise_count(every[k + 1 :] ^ x) <= 3]:
            assert root(int(x)) == root(int(y))
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in found.collect())


def test_unequal_thresholds_win_where_bits_are_dead():
    rng = np.random.default_rng(3)
    n = 10**8
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, :16] = 1  # tell nothing apart
    bits[:, 16:24] = bits[:, 24:32]  # correlated
    sample = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()
    x = bits.astype(float)
    scheme = simhash.allot(n, x.T @ x * (n / 2000), simhash.pair_differences(sample))
    assert len({t for _, t in scheme}) > 1 or len({len(part) for part, _ in scheme}) > 1 or len(scheme) < 4
    assert sum(t + 1 for _, t in scheme) == 4 and not any(set(part) == set(range(16)) for part, _ in scheme)


def test_thresholds_meet_the_principle():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (4000, 64)).astype(float)
    for n in (4000, 10**7, 10**10):
        scheme = simhash.allot(n, x.T @ x * n / 4000)
        m = len(simhash.group_bits(n, x.T @ x, len(scheme)))
        assert sum(t + 1 for _, t in scheme) == 4 and m >= 1  # sum of thresholds is 3 - m + 1, skipped parts count -1
    for n in (0, 1, 2):
        assert sum(comb(len(part), t) for part, t in simhash.allot(n, np.zeros((64, 64)))) <= 64
    assert len(simhash.allot(4000, x.T @ x)) >= len(simhash.allot(10**10, x.T @ x * 2.5e6))


# ------------------------------------------------------------------------ bpe


def test_bpe_matches_the_library(messy, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = bpe.encode_texts(messy, path, with_ids=True).collect()
    want = Counter()
    for k, t in rows:
        i = library.encode(t or "", add_special_tokens=False).ids
        want[k, tuple(i), library.decode(i, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in out) == want
    assert all(r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe.encode_texts(empty, path).count() == 0


def test_bpe_words(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeinrtschßéñ'"), int(rng.integers(1, 14)))) for _ in range(3000)] + ["a" * 5000, "!" * 900, "ab" * 700, "日本語" * 20]
    texts = [*words, "ΑΣ don't I'LL", "<|startoftext|>x<|endoftext|>"]
    for t, (n, raw, decoded) in zip(texts, ours.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want and n == len(want) and decoded == library.decode(want, skip_special_tokens=False), t[:50]


def test_bpe_repairs_only_what_fails():
    ours = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    n, failed = ours.learn(["the", "house", "internationally", "erthblenting", "onwhst"])
    assert n == 5 and failed < 5


# -------------------------------------------------------------------- licences


def brute_licenses(text, templates, threshold=0.8):
    """Every window of every template."""
    w, out = license_scan.words_of(text or ""), []
    for name, n, grams in license_scan.template_table(templates):
        best = None
        for p in range(max(1, len(w) - n + 1)):
            d = {f"{a} {b}" for a, b in zip(w[p : p + n], w[p + 1 : p + n], strict=False)}
            dice = 2 * len(d & set(grams)) / (len(d) + len(grams))
            if d and dice >= threshold and (best is None or dice > best[0]):
                best = (dice, p)
        if best:
            out.append((*best, name))
    return sorted(out, key=lambda x: (x[1], x[2], -x[0]))


def test_licenses(messy, empty, rows):
    out = license_scan.scan_licenses(messy, ["doc_id", "fp"]).collect()
    want = []
    for k, t in rows:
        found = brute_licenses(t, license_scan.TEMPLATES)
        top = min(found, key=lambda x: (-x[0], x[1], x[2]), default=(None, None, None))
        want.append((k, len(found), top[2], ",".join(f"{p}:{n}" for _, p, n in found)))
    assert Counter((r.doc_id, r.n_matches, r.license, r.matches) for r in out) == Counter(want)
    by = {r.doc_id: r for r in out}
    assert (by[13].license, by[13].dice, by[13].word_no) == ("mit", 1.0, 0) and by[0].license is None
    assert by[14].matches.endswith(":gpl-3.0") and ":mit" in by[14].matches
    assert license_scan.scan_licenses(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("piece", [40, 300, 1 << 20])
def test_license_windows_are_brute_force(monkeypatch, piece):
    """Notices wrapped over lines, within a line, edited, repeated, and cut by pieces."""
    monkeypatch.setattr(license_scan, "PIECE", piece)
    rng = np.random.default_rng(piece)
    texts = ["The authors thank all readers. Licensed under CC BY-NC 4.0. Copies may be requested by mail.", "", None, "a", "x" * 5000, "mit license " * 300]
    notices = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    for _ in range(12):
        w = license_scan.words_of(notices[int(rng.integers(len(notices)))])
        for at in rng.choice(len(w), max(1, len(w) // 30), replace=False):
            w[at] = ["changed", "", f"{w[at]} more"][int(rng.integers(3))]
        lines = [" ".join(w[k : k + 8]) for k in range(0, len(w), 8)]
        texts.append(prose(rng, int(rng.integers(0, 60))) + "\n# " + "\n# ".join(lines) + "\n" + prose(rng, int(rng.integers(0, 60))))
    scanner = license_scan.Scanner()
    found = [scanner.scan(t) for t in texts]
    assert found == [brute_licenses(t, license_scan.TEMPLATES) for t in texts]
    assert found[0][0][2] == "cc-by-nc-4.0" and sum(map(bool, found[6:])) >= 10


def test_license_size_bounds_lose_nothing():
    for n in range(1, 200):
        low, high = license_scan.size_bounds(n, 0.8)
        for m in range(1, 400):
            best = 2 * min(n, m) / (n + m)
            assert (low <= m <= high) == (best >= 0.8 - 1e-12)


# ----------------------------------------------------------------- exact dedup


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("digest", [None, lambda x: F.substring(F.sha2(x, 256), 1, 1)])
@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup(messy, rows, digest, files, monkeypatch):
    if files:
        monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", 0)
    docs, row = exact_dedup.with_row(messy)
    options = {"files_per_batch": files} | ({"digest": digest} if digest else {})
    out = exact_dedup.exact_groups(docs, row, **options).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for k, t in rows:
        groups[strip(t)].append((-len(t or ""), k is None, k or 0))
    want = Counter((k, min(groups[strip(t)])[2] if not min(groups[strip(t)])[1] else None, len(groups[strip(t)])) for k, t in rows)
    assert Counter((r.id, r.keep_id, r.group_size) for r in out) == want
    assert sum(r.row == r.keep_row for r in out) == len(groups)


def test_exact_dedup_keeps_all_columns(messy, empty, rows):
    kept = exact_dedup.dedup_exact(messy)
    assert kept.columns == messy.columns and kept.count() == len({strip(t) for _, t in rows})
    assert exact_dedup.dedup_exact(empty).count() == 0


# ------------------------------------------------------------------ line dedup


def test_line_dedup(spark, messy, empty):
    pages = [(k, f"https://a.example/{k}", f"<p>menu</p><p>menu</p><p>page {k}</p><script>x</script>b<b>o</b>ld &amp; c") for k in range(10)]
    pages += [(10, "https://a.example/x", None), (11, None, "<p>menu</p>"), (12, "https://b.example", "menu<br>only"), (None, "bad url", "")]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, n_lines int")
    out = {r.page_id: r for r in line_dedup.drop_site_boilerplate(df, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")), 0.3).collect()}
    assert (out[3].host, out[3].n_lines, out[3].n_dropped, out[3].clean_text) == ("a.example", 4, 3, "page 3")
    assert (out[10].n_lines, out[10].clean_text, out[11].host, out[11].clean_text) == (0, "", "", "menu")
    assert out[12].clean_text == "menu\nonly" and out[None].n_lines == 0
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    assert line_dedup.drop_site_boilerplate(messy, F.col("source"), lines).count() == messy.count()
    assert line_dedup.drop_site_boilerplate(empty, F.col("source"), lines).count() == 0


def test_line_dedup_on_small_sites(spark):
    """The ratio holds for every host; only a line on one page alone is always kept."""
    pages = [(k, "https://two.example", f"menu\nonly {k}") for k in range(2)] + [(9, "https://one.example", "menu\nmenu")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r.clean_text for r in line_dedup.drop_site_boilerplate(df, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")), 0.3).collect()}
    assert out == {0: "only 0", 1: "only 1", 9: "menu\nmenu"}


def test_line_dedup_takes_long_pages(spark):
    pages = ["<p>a</p>" + "\n" * 1_000_000 + "b", "<i>" * 100_000 + "x" + "</p>" * 100_000, "<" * 300_000, "<!--" * 200_000, "<script>" * 50_000, "<a " * 100_000, "w" * 2_000_000, "&amp;" * 100_000]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id long, html string")
    out = {r.page_id: r.lines for r in df.select("page_id", line_dedup.html_lines(F.col("html")).alias("lines")).collect()}
    assert (out[0], out[1], out[3], out[4]) == (["a", "b"], ["x"], [], []) and out[6] == [pages[6]] and out[7] == ["&" * 100_000]


# --------------------------------------------------------------------- packing


def test_packing_round_trip(messy, empty, rows):
    out = packing.pack_documents(messy, byte_bpe()).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, t in rows:
        want[k, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    ids_of = defaultdict(list)
    for (k, i), n in want.items():
        ids_of[k] += [i] * n
    sequences = defaultdict(list)
    for r in out:
        assert any(len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i in ids_of[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(i) * n for (_, i), n in want.items())
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert packing.pack_documents(empty, byte_bpe()).count() == 0


def test_packing_plan_uses_no_length_beyond_its_supply():
    rng = np.random.default_rng(8)
    hist = Counter(int(x) for x in rng.integers(1, 1024, 20_000))
    slots, used, sequences = packing.plan(dict(hist))
    assert all(used[k] <= hist[k] for k in hist) and sum(used.values()) > 0.8 * sum(hist.values())
    assert sum(length * (hi - lo) for length, lo, hi, _, _ in slots) == 1024 * sequences


# --------------------------------------------------------------------- quality


def test_quality(spark, messy, empty):
    rng = np.random.default_rng(6)
    texts = [prose(rng, 120) if k % 2 else prose(rng, 60) + "\n" + prose(rng, 60).upper().replace(" ", "!! ") for k in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(500)] + [(None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).withColumn("held", quality.held_out()).collect()
    held = [r for r in scored if r.held]
    assert len(held) > 50 and np.mean([(r.score >= 0.3) == (r.doc_id % 2) for r in held]) > 0.95
    assert {r.doc_id for r in held} == {k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0}
    out = quality.score(messy, model)
    assert Counter(out.columns) == Counter(messy.columns) and out.where("score between 0 and 1").count() == messy.count()
    assert quality.score(empty, model).count() == 0
    assert quality.fit(empty, labels.limit(0)) is None and quality.score(docs, None).where("score = 0.5").count() == 500


def test_attention_gradient_matches_differences():
    rng = np.random.default_rng(0)
    h, a, n = 4, 3, 5
    p = {"w": rng.normal(size=(n, h)), "b": rng.normal(size=h), "v": rng.normal(size=(h, a)), "u": rng.normal(size=(h, a)), "a": rng.normal(size=a), "c": rng.normal(size=h), "d": np.array(0.3)}
    x, size, y = rng.normal(size=(7, n)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss(q):
        s = quality.Model(np.zeros(n), np.ones(n), q).score(x, size)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = quality._gradient(p, x, size, y)
    for k in p:
        for at in list(np.ndindex(p[k].shape))[:6]:
            up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-6


def passage_features(passage):
    """The features of one passage, byte by byte."""
    kinds = Counter(int(quality._CLASS[c]) for c in passage)
    size = max(1, len(passage))
    pairs = Counter((a * 31 + b) % quality.PAIRS for a, b in zip(passage, passage[1:], strict=False))
    total = max(1, sum(pairs.values()))
    doubled = sum(a == b and quality._CLASS[b] >= 8 for a, b in zip(passage, passage[1:], strict=False))
    upper = sum(65 <= a <= 90 and 65 <= b <= 90 for a, b in zip(passage, passage[1:], strict=False))
    shares = [(kinds[k] / size) ** 0.5 for k in range(quality.CLASSES)]
    return [
        *shares,
        np.log1p(len(passage)) / 6,
        sum(v * v for v in pairs.values()) / total**2 * 20,
        len(pairs) / total,
        max(pairs.values(), default=0) / total * 10,
        size / (kinds[4] + kinds[5] + 1) / 10,
        kinds[2] / max(1, kinds[1] + kinds[2]),
        upper / size * 2,
        doubled / size * 5,
    ]


def plain_score(text, model):
    """Gated attention, passage by passage."""
    p, raw = model.weights, (text or "").encode()
    hs, logits = [], []
    for at in range(0, max(1, len(raw)), quality.PASSAGE):
        x = (np.array(passage_features(raw[at : at + quality.PASSAGE])) - model.mean) / model.scale
        h = np.tanh([sum(x[i] * p["w"][i, j] for i in range(len(x))) + p["b"][j] for j in range(quality.HIDDEN)])
        gate = [np.tanh(h @ p["v"][:, j]) / (1 + np.exp(-(h @ p["u"][:, j]))) for j in range(quality.ATTENTION)]
        hs.append(h)
        logits.append(sum(g * a for g, a in zip(gate, p["a"], strict=True)))
    e = np.exp(np.array(logits) - max(logits))
    z = sum(w * h for w, h in zip(e / e.sum(), hs, strict=True))
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))


def random_model(seed):
    rng = np.random.default_rng(seed)
    shapes = {"w": (quality.FEATURES, quality.HIDDEN), "b": quality.HIDDEN, "v": (quality.HIDDEN, quality.ATTENTION), "u": (quality.HIDDEN, quality.ATTENTION), "a": quality.ATTENTION, "c": quality.HIDDEN}
    return quality.Model(rng.normal(size=quality.FEATURES) * 0.1, rng.uniform(0.5, 2, quality.FEATURES), {k: rng.normal(size=v) * 0.4 for k, v in shapes.items()} | {"d": np.array(0.1)})


@pytest.mark.parametrize("cut", [quality.PASSAGE, 4 * quality.PASSAGE, quality.SLICE])
def test_quality_scores_are_those_of_a_plain_loop(spark, messy, rows, monkeypatch, cut):
    monkeypatch.setattr(quality, "SLICE", cut)
    model = random_model(cut)
    texts = [t for _, t in rows] + ["AB!!c\n" * 900, "é" * 1400, "x" * 512, "x" * 513, ""]
    got = quality.score_texts(pa.array(texts), model)
    assert np.allclose(got, [plain_score(t, model) for t in texts], atol=1e-5)
    assert np.allclose(quality.score_texts(pa.array(texts).slice(3, 9), model), got[3:12])
    want = Counter((k, round(float(s), 4)) for (k, _), s in zip(rows, got[: len(rows)], strict=True))
    assert Counter((r.doc_id, round(r.score, 4)) for r in quality.score(messy, model).collect()) == want


def test_quality_takes_the_memory_of_a_slice():
    tracemalloc.start()
    assert 0 <= quality.score_texts(pa.array(["lorem Ipsum, 12 " * 1_000_000]), random_model(1))[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # 16 MB of text
    tracemalloc.stop()
