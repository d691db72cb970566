"""Operators on texts and tables, against brute force; nulls, empty and long texts, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import mixing, ngram_join, ordinal, pieces, quality_rules, token_counts, token_files, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], SCHEMA)
    if extra:  # names that operators use inside
        for name in ("h", "w", "node", "kept", "size", "stratum", "doc", "key", "rk1", "block", "bands"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice(["un", "der", "the", "ha", "é", "zu"]) + rnd.choice(["ing", "ed", "ñ", "x", ""]) + rnd.choice(["", ",", "."]) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 60, 120, 400])))
        rows.append((i, text if i % 3 else text.replace(". ", ".\n"), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None])))
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n ", "en", "b"), (None, "one two three four five six", "en", "a"), (n + 3, rows[5][1], "de", "a"), (n + 3, rows[5][1], "de", "a")]
    rows.append((n + 4, " ".join(rnd.choices(vocabulary, k=30_000)), "en", "c"))
    words = rows[7][1].split()
    rows.append((n + 5, " ".join(words[:-1] + ["changed"]), "en", "b"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


# ---- op 1


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(spark, rows):
    labels = spark.createDataFrame([(i, i % 5 != 0 and 1 or 0, 0) for i in range(40)] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(make(spark, rows, True), labels).collect()
    counts = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = Counter((i, *(b := base(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t, _, _ in rows)
    assert counts == want and all(not r.kept for r in got if r.base_failed)
    kept = quality_rules.keep_by_rules(make(spark, rows, True), labels)
    assert kept.columns == make(spark, rows, True).columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.quality_rules(make(spark, []), labels).count() == 0
    assert quality_rules.quality_rules(make(spark, rows), labels.limit(0)).filter("kept = base_failed").count() == 0


def test_quality_rules_bound(spark):
    """Cutoffs are admissible exactly where the binomial tail is, per stratum."""
    from pyspark.sql import functions as F

    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    df = spark.createDataFrame([(k, n) for n in (1, 10, 400) for k in (0, 1, 5, n) if k <= n], "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        assert r.p == pytest.approx(tail(r.k, r.n, 0.01), rel=1e-9)
    signals = list(quality_rules.GRID)
    data = [("en", True, *[0.03 if s == "symbol_share" and i < 2 else -9.0 for s in signals]) for i in range(6000)] + [("fr", True, *[0.03] * len(signals))]
    cuts = {r.stratum: r for r in quality_rules.thresholds(spark.createDataFrame(data, ["stratum", "good", *signals]), 0.02, 0.05).collect()}
    assert cuts["en"].symbol_share_cut == 0.005  # two of 6000 good documents lost is well within the bound
    assert cuts["fr"].symbol_share_cut is None  # one document proves nothing


def test_quality_rules_of_many_strata(spark):
    """Each of 90 strata has cutoffs of its own; a repeated labelled document is one trial; null and unlabelled strata lose none."""
    rnd = random.Random(21)
    texts, labels = [], []
    for i in range(3000):
        stratum = None if i % 97 == 0 else f"s{i % 90}" if i % 90 < 80 else f"unlabelled{i % 90}"
        bad = rnd.random() < 0.1
        symbols = "#" * (90 if bad else rnd.choice([0, 0, 0, 3, 9]))
        texts.append((i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) + " " + symbols, stratum, "a"))
        if i % 90 < 80:
            labels.append((i, int(not bad), 0))
    texts += [texts[5]] * 400  # as often as it comes, it is one document
    df, marks = make(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    alpha, delta = 2.0, 0.5
    got = quality_rules.quality_rules(df, marks, alpha, delta).collect()
    good, shares = {i for i, q, _ in labels if q}, {}
    for i, t, s, _ in texts:
        n, chars, symbols, _, _ = base(t)
        shares[i] = (s, symbols / chars, n)
    by = {}
    for i, (s, share, _) in shares.items():
        if s is not None and i in good:
            by.setdefault(s, []).append(share)
    tests, each = len(by) * sum(map(len, quality_rules.GRID.values())), alpha / len(quality_rules.GRID)
    cut = {}
    for s, found in by.items():
        for c in quality_rules.GRID["symbol_share"][::-1]:
            k, n = sum(x > c for x in found), len(found)
            if sum(math.comb(n, j) * each**j * (1 - each) ** (n - j) for j in range(k + 1)) <= delta / tests:
                cut[s] = c
    assert len(by) == 80 and 40 < len(cut)
    for r in got:
        s, share, _ = shares[r.doc_id]
        if s not in by:
            assert r.kept
        elif s in cut and share > cut[s]:
            assert not r.kept
    assert any(not r.kept for r in got)


# ---- op 2 and 10


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    got = sorted((tuple(r) for r in token_files.token_files(make(spark, rows, True)).collect()), key=lambda r: r[1])
    start, left = 0, Counter()
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        left[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        left[doc_id, n, crc] -= 1
    assert not +left and [r[0] for r in got[1:]] == sorted(r[0] for r in got[1:]) and got[0][0] is None
    assert token_files.token_files(make(spark, [])).count() == 0


def test_shuffled_reads_and_hot_ids(spark, rows):
    from cellweave.llm import common

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or tables this small end in one task
    hot = [(7, f"text {i} of one id", "en", "a") for i in range(400)] + [(None, f"no id {i}", "en", "a") for i in range(300)]
    df, root = make(spark, rows + hot), common.shared_dir(spark)
    manifest = token_files.write_tokens(df, root, tokens.default_path())
    found = token_files.shuffled_tokens(manifest, root, 3).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in token_files.shuffled_tokens(manifest, root, 3).collect()]
    assert sorted((str(r.doc_id), len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in found) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(manifest, root).collect())
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append((r.place, -1 if r.doc_id is None else r.doc_id))
    assert all([p for p, _ in v] == list(range(len(v))) for v in by_shard.values()) and any([d for _, d in v] != sorted(d for _, d in v) for v in by_shard.values())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(any(r.doc_id == 7 for r in found if r.shard == s) for s in by_shard) > 1  # one id's rows are not all in one task


def test_records_are_checked(tmp_path):
    record = token_files.frame(b"payload")
    (tmp_path / "x").write_bytes(record)
    with open(tmp_path / "x", "rb") as f:
        assert token_files.unframe(f, 0) == b"payload"
    for at in range(len(record)):
        (tmp_path / "y").write_bytes(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])
        with open(tmp_path / "y", "rb") as f, pytest.raises(ValueError):
            token_files.unframe(f, 0)


ODD = ["a  b", "a \n b", "  x ", "\n\n a\n", "a   ", "<|endoftext|> a", "é　 b\xa0c", "日本 語 😀 x", "a\t b", "", " ", "x  y", "a \x1c b", "x. y.z, a.. b,. c", "a\n\nb\nc\n", "i'm. it's, don't", "a\n", "\nb", "a\n\n\nb", "1, 2. 3,", "ñ, é.", "a.\nb,\n", "a\r\nb", "\x00a b"]


def test_encoding_by_stretches_is_exact():
    enc = tokens.encoder(tokens.default_path())
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab eth \n.,'é日\t  0!") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    for text, ids, spans in zip(texts, enc.ids(texts), enc.spans(texts)):
        want = enc.tokenizer.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u2").tolist() == want.ids, text
        assert [tuple(x) for x in spans.tolist()] == want.offsets, text


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rows, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    got = Counter((r.doc_id, r.n_tokens, r.n_sections, r.n_crossing, tuple(r.section_tokens)) for r in token_counts.token_counts(make(spark, rows, True), rule=rule).collect())
    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        lines = text.splitlines(keepends=True) if not re.search("[\x0b\x0c\r\x1c-\x1e\x85  ]", text) else re.findall(r"[^\n]*\n|[^\n]+", text)
        lines = lines or [""]
        of = [k for k, line in enumerate(lines) for _ in line]
        counts, crossing = [0] * len(lines), 0
        offsets = t.encode(text, add_special_tokens=False).offsets
        for a, b in offsets:
            crossing += of[a] != of[b - 1]
            counts[of[a] if rule == "first" else min(range(len(lines)), key=lambda k: (-of[a:b].count(k), k))] += 1
        want[i, len(offsets), len(lines), crossing, tuple(counts)] += 1
    assert got == want
    assert token_counts.token_counts(make(spark, [])).count() == 0


def test_crossing_tokens_go_by_the_rule():
    spans, starts = np.array([[0, 4], [4, 9], [9, 12]]), np.array([0, 2, 8])
    assert token_counts.attributed(spans, starts, "first")[0].tolist() == [0, 1, 2] and token_counts.attributed(spans, starts, "most")[0].tolist() == [0, 1, 2]
    assert token_counts.attributed(np.array([[0, 5]]), np.array([0, 1, 2]), "most") [0].tolist() == [2] and token_counts.attributed(np.array([[0, 5]]), np.array([0, 1]), "first")[1] == 1


# ---- op 3


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45) == [20.0, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 0], [3, 1], 0) == [0.0, 0.0]
    sizes = [5, 700, 30, 1, 90]
    got = mixing.targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes))
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))


def test_splitting_tree_uses_every_draw_once():
    quotas = np.array([40, 0, 3, 600])
    leaves = dict(mixing.split(quotas, 0, 13, 7))
    assert sorted(leaves) == list(range(13)) and (sum(leaves.values()) == quotas).all() and max(int(v.sum()) for v in leaves.values()) - min(int(v.sum()) for v in leaves.values()) <= 4
    tops = mixing._tops(quotas.tolist(), 13, 7)
    again = {s: q.tolist() for f, n, q, _ in tops for s, q in mixing.split(np.array(q), f, n, 7)}
    assert again == {s: q.tolist() for s, q in leaves.items()}


def test_mixing(spark, rows):
    df = make(spark, rows, True)
    got = mixing.mixed_sizes(df).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))))
    taken = Counter()
    source_of = {i: s for i, _, _, s in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.taken <= 2 * r.size and r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert len(r.shards) == -(-r.taken // r.size) if r.size else not r.shards
        taken[s] += r.taken
    assert all(taken[s] == round(goal[s]) for s in order) and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(df.repartition(7)).collect()))
    copies = mixing.mixed_documents(df, whole=False)
    assert copies.columns == df.columns and sum(len(WORD.findall(r.text)) for r in copies.collect()) == sum(taken.values())
    assert mixing.mixed_sizes(make(spark, [])).count() == 0 and mixing.mixed_documents(make(spark, [])).count() == 0


def test_shards_are_hypergeometric_samples():
    quotas, shards, seeds = [9, 14, 7], 3, 3000
    total, leaf = sum(quotas), Counter(int(next(q for s, q in mixing.split(np.array(quotas), 0, shards, seed) if s == 0)[0]) for seed in range(seeds))
    n = total * (shards // 2) // shards
    chi = 0.0
    for k in range(min(n, quotas[0]) + 1):
        p = math.comb(quotas[0], k) * math.comb(total - quotas[0], n - k) / math.comb(total, n)
        chi += (leaf[k] - seeds * p) ** 2 / max(seeds * p, 0.5)
    assert chi < 30  # 9 degrees of freedom
    rng = np.random.default_rng(5)
    for good, bad, n in ((0, 5, 3), (5, 0, 3), (1, 1, 1), (40, 60, 30), (3, 10**6, 10**5)):
        xs = [mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)]
        mean = n * good / (good + bad)
        assert abs(np.mean(xs) - mean) <= 5 * math.sqrt(mean * bad / (good + bad) / 4000 + 1e-9) and max(0, n - bad) <= min(xs) and max(xs) <= min(n, good)
    # beyond 1e9, in which the same law holds: mean 3e11, deviation about 2.8e5
    xs = np.array([mixing.hypergeometric(rng, 6 * 10**9, 14 * 10**9, 10**10) for _ in range(200)])
    z = (xs - 3e9) / math.sqrt(1e10 * 0.3 * 0.7 * 0.5)
    assert abs(z.mean()) < 0.35 and 0.8 < z.std() < 1.2


def test_a_shard_is_read_in_its_own_order(spark, rows):
    df = make(spark, [r for r in rows if r[0] is not None] * 1 + [(1000 + i, f"w{i} " * 60, "en", "z") for i in range(600)])
    mixed = mixing.mix(df, ["doc_id"], 7).selectExpr("doc.doc_id as doc_id", "explode(draws) as d").selectExpr("doc_id", "d.shard as shard", "d.place as place").collect()
    want = {}
    for r in mixed:
        want.setdefault(r.shard, []).append((r.place, r.doc_id))
    got = [[r.doc_id for r in part] for part in mixing.mixed_documents(df).rdd.glom().collect()]
    orders = {s: [d for _, d in sorted(v)] for s, v in want.items()}
    flat = [d for part in got for d in part]
    assert sorted(flat) == sorted(d for v in orders.values() for d in v)
    assert all(any(v == part[i : i + len(v)] for part in got for i in range(len(part))) for v in orders.values())
    assert any(v != sorted(v) for v in orders.values())


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    texts = [(i, "\n".join(" ".join(rnd.choice("ab cd ef gh".split()) for _ in range(9)) + "  " for _ in range(rnd.randint(1, 40))), "en", f"s{i % 4}") for i in range(60)]
    df = make(spark, texts + [(60, "one\n\nlong  text " * 500, "en", "s9")])
    cut = [r for r in mixing.mixed_sizes(df).collect() if r.taken % r.size]
    assert cut  # some copies end inside their document
    got = corpus_pipeline.mix(spark, df, None)
    assert got.subtract(df).count() == 0
    copies = Counter(r.doc_id for r in got.collect())
    assert all(copies[r.doc_id] == -(-r.taken // r.size) for r in mixing.mixed_sizes(df).collect())


# ---- op 5


def test_sentence_pieces(spark, rows):
    enc = pieces.piece_encoder(pieces.default_model())
    rnd = random.Random(9)
    texts = ODD + ["▁a▁▁b", "<s>x</s>", "<0x0A>", "x" * 300, "日本語" * 50] + ["".join(rnd.choice("aabething  \n▁.,éü日\t0x<s>🙂 ther") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        assert enc.encode(text).tolist() == enc.processor.encode(text, add_bos=True, add_eos=True), text
        line = text.replace(" ", "▁").replace("\n", "")[:40]
        assert enc.backtracked(line) == enc.merged(line)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.sentence_pieces(make(spark, rows, True)).collect())
    want = Counter()
    for i, text, *_ in rows:
        ids = enc.processor.encode(text or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.processor.decode(ids).encode()).hexdigest()] += 1
    assert got == want and pieces.sentence_pieces(make(spark, [])).count() == 0


# ---- op 6


def near(rnd, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"new{rnd.random()}"
    return " ".join(words)


def family(seed=11, members=330):
    rnd = random.Random(seed)
    rows = []
    for g in range(6):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 150]))]
        for _ in range(members if g == 0 else 8):
            rows.append((len(rows), near(rnd, words, rnd.choice([0, 0, 1, 2, 3])), "en", "a"))
    rows += [(len(rows) + k, t, "en", "a") for k, t in enumerate([None, "", "a b", "a b", "a  b", "c"])]
    rows += [(None, rows[0][1], "en", "a"), (3, rows[3][1], "en", "a")]
    return rows


def brute(rows, threshold=0.8):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[find(b)] = find(a)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, math.inf), math.inf if doc_id is None else doc_id)
    return Counter((rows[i][0], None if least[find(i)] == math.inf else int(least[find(i)]), links[i]) for i in range(len(rows)))


def test_ngram_join(spark):
    rows = family()
    df = make(spark, rows, True)
    want = brute(rows)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect())
    # a pair at the threshold is met with probability 0.999, links further above it almost surely
    assert sum((got & want).values()) >= 0.99 * sum(want.values())
    exactly = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df, recall=1 - 1e-9).collect())
    assert exactly == want
    kept = ngram_join.one_of_each(df, recall=1 - 1e-9)
    assert kept.columns == df.columns
    classes = {(c, d if d is None else 0) for d, c, _ in want if c is not None}
    assert Counter(r.doc_id for r in kept.collect() if r.text and r.text.strip()) == Counter(c for c, _ in {(c, 0) for c, _ in classes} if any(WORD.search(t or "") for i, t, *_ in rows if i == c))
    assert ngram_join.ngram_join(make(spark, [])).count() == 0 and ngram_join.one_of_each(make(spark, [])).count() == 0


def test_ngram_join_finds_every_pair_of_the_documents(spark):
    """Whole table against brute force, at the recall of production."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(make(spark, docs)).collect())
    want = brute(docs)
    assert got == want and sum(n for *_, n in want.elements()) > 0


def test_ngram_join_of_repeats_and_very_long_texts(spark):
    rnd = random.Random(31)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words), "en", "a"), (2, near(rnd, words, 40), "en", "a"), (3, " ".join(words[:30_000]), "en", "a")]
    rows += [(4, "one text that is repeated as it stands with its id", "en", "a")] * 2000 + [(None, "another that has no id at all", "en", "b")] * 500
    df = make(spark, rows)
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 1999), (None, None, 499)}
    kept = ngram_join.one_of_each(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]


def test_bands():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = ngram_join.bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 90) if i % 10 != 9] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node)[0]: bytes(r.label)[0] for r in ngram_join.components(df).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent}


# ---- op 7


def test_ordinal_fit_recovers_order():
    rnd = np.random.default_rng(4)
    x, y = [], []
    for _ in range(900):
        v = rnd.normal(size=3)
        score = 2 * v[0] - v[1] + rnd.logistic()
        x.append((np.array([1, 2, 3]), v))
        y.append(0 if score < -1 else 1 if score < 1 else 2)
    model = ordinal.OrdinalModel.fit(x[:600], y[:600], 3, steps=400)
    assert model.thresholds[0] < model.thresholds[1] and model.weights[1] > 1 and model.weights[2] < -0.4
    tails = np.array([model.tails(*r) for r in x[600:]])
    assert (tails[:, 0] >= tails[:, 1]).all() and np.mean((tails > 0.5).sum(1) == y[600:]) > 0.6


def test_classifier_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    _, cut, report = ordinal.train(docs, labels)
    assert report["kept_by_grade"][2] >= 0.98 and report["kept_by_grade"][0] <= 0.2 and 0 <= cut <= 0.5


def test_classifier_rejects_held_out_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model, _, report = ordinal.train(docs, labels)
    kept = report["kept_by_grade"]
    assert kept[0] <= 0.05 and kept[1] <= 0.25 and kept[2] >= ordinal.KEEP_SHARE - 0.002, kept
    assert all(model.weights[ordinal._word(w)] < 0 for w in (b"trash", b"idiot", b"scum"))


def test_features_met_by_chance_have_no_evidence():
    y = np.arange(400) % 2
    rows = [(np.unique(np.array([1, 10 + i % 7, 100 + i // 2, 1000 + i] + ([2] if g else []))), None) for i, g in enumerate(y)]
    got = ordinal.evidence(rows, y, 2)
    assert np.flatnonzero(got).tolist() == [2]


def test_ordinal_fit_is_the_likelihood_s_minimum():
    """Against a plain fit: dense features, gradients by differences, many small steps."""
    rnd = np.random.default_rng(14)
    dense = rnd.normal(size=(120, 3))
    y = np.clip(np.round(dense[:, 0] - 0.5 * dense[:, 1] + rnd.logistic(size=120) * 0.7 + 1), 0, 2).astype(int)
    ridge = 0.05

    def loss(theta):
        cuts = [-np.inf, theta[3], theta[3] + np.exp(theta[4]), np.inf]
        up, low = (1 / (1 + np.exp(-(np.array(cuts)[y + k] - dense @ theta[:3]))) for k in (1, 0))
        return -np.mean(np.log(up - low)) + ridge / 2 * np.sum(theta[:3] ** 2)

    theta = np.array([0.0, 0, 0, -1, 0])
    for _ in range(3000):
        step = np.array([(loss(theta + e) - loss(theta - e)) / 2e-5 for e in np.eye(5) * 1e-5])
        theta -= 0.5 * step
    model = ordinal.OrdinalModel.fit([(np.array([4, 5, 6]), v) for v in dense], y, 3, steps=3000, rate=0.02, ridge=ridge)
    assert model.weights[4:7] == pytest.approx(theta[:3], abs=5e-3)
    assert model.thresholds == pytest.approx([theta[3], theta[3] + math.exp(theta[4])], abs=5e-3)


def test_classifier_does_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(41)
    rows = [(i % 90, " ".join(rnd.choice(["good", "fine", "bad", "ugly", "plain"]) if i % 3 else "bad ugly" for _ in range(30)) + f" {i}", "en", "a") for i in range(360)]  # four texts of an id
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    found = []
    for order, parts in ((rows, 1), (rows[::-1], 3), (sorted(rows, key=str), 7)):
        got = ordinal.quality_classifier(make(spark, order).repartition(parts), labels).collect()
        found.append(sorted((r.doc_id, r.expected_grade, r.tail_probability, r.kept) for r in got))
    assert found[0] == found[1] == found[2]


def test_classifier_edges(spark, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    df = make(spark, rows, True)
    got = ordinal.quality_classifier(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    kept = ordinal.keep_selected(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert ordinal.quality_classifier(make(spark, []), labels).count() == 0
    assert ordinal.quality_classifier(df, labels.limit(0)).filter("kept").count() == len(rows)


def test_blocks_by_size_change_nothing(spark, monkeypatch):
    """Groups cut into many blocks, because their texts are long, give the same links."""
    rows = family(seed=12, members=40)
    df = make(spark, rows)
    whole = sorted(map(str, ngram_join.ngram_join(df, recall=1 - 1e-9).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 500)
    assert sorted(map(str, ngram_join.ngram_join(df, recall=1 - 1e-9).collect())) == whole
