import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phraseloom.llm import fm_index, langid, mixture, ngram_join, ogg, pii, queries, secrets_crf, suffix_dedup, toxicity, warc
from tests.conftest import DATA, compare

HERE = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
EXTRA = "doc_id long, text string, score double, spans string, digest string, key string, doc long, marks int, words int, low int, source string, lang string, n_chars long"


def table(spark, rows, source=None):
    """Documents with columns that operators use as names of their own."""
    full = [(i, t, 1.0, "s", "d", "k", 5, 1, 2, 3, source[n] if source else "s", "en", len(t or "")) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, EXTRA)


def low(t):
    return "".join(c.lower() if c < "\x80" else c for c in t or "")


def phrase(rng, n, vocabulary=400):
    return " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in (rng.randrange(vocabulary) for _ in range(n)))


def corpus(seed=1):
    """Texts with exact and near copies, a shared line, odd rows, and a repeated row."""
    rng = random.Random(seed)
    rows = []
    line = phrase(rng, 12)
    for k in range(30):
        words = phrase(rng, rng.choice([3, 8, 40, 120])).split()
        rows.append((k, " ".join(words) + ("\n" + line if k % 3 == 0 else "")))
    for k in range(30, 60):
        words = rows[rng.randrange(6)][1].split(" ")
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((k, " ".join(words)))
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "one"), (64, "ONE"), (65, "a b c d"), (66, rows[0][1].upper()), (0, rows[0][1]), (None, "null id text"), (67, phrase(rng, 5000))]
    return rows


def components_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i) if i is not None else None) for i, s in sets.items()}


def test_ngram_join(spark):
    rows = corpus()
    got = ngram_join.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = components_by_hand(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert sum(c != i for i, (_, c) in want.items()) > 10
    assert ngram_join.near_duplicates(table(spark, []).where("doc_id > 0")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for t in range(800):
        n = int(rng.integers(1, 40 if t % 2 else 500))
        base = rng.integers(0, 2**63, 2 * n + 4, dtype=np.int64).view(np.uint64)
        a = np.unique(base[:n])
        edits = int(rng.integers(0, int(n * 0.3) + 2))
        drop = min(int(rng.integers(0, edits + 1)), n - 1)
        b = np.unique(np.concatenate([a[drop:], base[n : n + edits - drop]]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 4 * both >= 3 * either:
            often = np.sort(rng.choice(np.union1d(a, b), int(rng.integers(0, either)), replace=False)) if t % 3 == 0 else a[:0]
            rare = lambda x: np.setdiff1d(x, often)  # noqa: E731, B023
            assert len(np.intersect1d(ngram_join.signatures(a, rare(a)), ngram_join.signatures(b, rare(b))))


def test_ngram_join_of_wide_groups(spark, monkeypatch):
    """Near copies of one text that a chain links, unlike texts with a common passage, a doc_id of two texts, blocks of few sets."""
    rng = random.Random(5)
    base, passage = phrase(rng, 60).split(), phrase(rng, 40)
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"y{rng.randrange(500)}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, phrase(rng, 12) + " " + passage) for k in range(60)] + [(3000 + k, phrase(rng, 200) + " " + passage) for k in range(20)]
    rows += [(5, phrase(rng, 30)), (9, phrase(rng, 30))]
    rows += [(7, rows[-2][1]), (7, rows[-1][1]), (7, rows[-1][1])]
    once = {}
    for i, t in rows[:-3]:
        once[i] = t
    for bound in (1 << 22, 2000):
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", bound)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
        want = {i: c for i, (_, c) in components_by_hand(list(once.items())).items()}
        assert {i: c for i, c in got.items() if i in want and i not in (5, 9)} == {i: c for i, c in want.items() if i not in (5, 9)}
        assert got[5] == got[7] == got[9] == 5
    assert 1 < len(set(want.values())) < len(want)


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([1, 2, 200])) for _ in range(rng.randint(0, 120))]
        assert suffix_dedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_may_repeat():
    rng = random.Random(8)
    for _ in range(400):
        part = bytes(rng.randrange(97, 100) for _ in range(rng.randint(1, 160)))
        text = bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 60))) + part * rng.randint(1, 4) + b"xyz" * rng.randint(0, 3) + part[: rng.randint(0, 160)]
        windows = [text[k : k + 100] for k in range(len(text) - 99)]
        assert suffix_dedup.may_repeat(text) or len(set(windows)) == len(windows)


@pytest.mark.parametrize("hot", [20_000, 5])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    part = "".join(chr(97 + rng.randrange(26)) for _ in range(400))
    texts = ["Ha " * 45, "Ha " * 34, "a" * 3000, part[:150] + "é" * 80 + part[100:300], part[50:260], None, "", "é" * 60 + part[:99], "b" * 100, "b" * 101, ("qrstuv" * 40)[:170]]
    texts += [str(j) * 7 + part[:180] + str(j) * 9 for j in range(20)] + [phrase(rng, 3000)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, part), (None, part[200:] + "c" * 30 + part[200:]), (None, phrase(rng, 90)), (4, "z" * 9 + part[20:220]), (4, texts[-1][:300])]
    keys = {(r["doc_id"], r["text"]): (r["doc"], r["key"]) for r in suffix_dedup.keyed(table(spark, rows)).collect()}
    order = sorted(set(rows), key=lambda r: keys[r[0], r[1] or ""])
    seen, want = {}, set()
    for i, t in order:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if seen.setdefault(raw[k : k + 100], (i, t, k)) != (i, t, k):
                gone[k : k + 100] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.add((i, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.deduplicate(table(spark, rows)).collect()
    assert len(got) == len(rows) and {tuple(r)[:5] for r in got} == want
    if hot == 5:
        assert suffix_dedup.deduplicate(table(spark, []).where("doc_id > 0")).count() == 0


@pytest.mark.parametrize("hot", [20_000, 5])
def test_suffix_dedup_of_rows_in_any_order(spark, monkeypatch, hot):
    """A table's rows come in another order whenever it is read, and stretches end elsewhere."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 40)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 3000, raising=False)
    monkeypatch.setattr(suffix_dedup, "runs", lambda batches, column, limit: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    rng = random.Random(9)
    part = "".join(chr(97 + rng.randrange(26)) for _ in range(400))
    rows = [(k, phrase(rng, 5) + part[rng.randrange(150) : rng.randrange(240, 400)] + phrase(rng, 5)) for k in rng.sample(range(999), 240)]

    def stirred(batches):
        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(pa.array(order))

    seen, want = {}, {}
    for i, t in sorted(rows):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if seen.setdefault(t[k : k + 100], (i, k)) != (i, k):
                gone[k : k + 100] = True
        want[i] = (len(t), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest())
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = suffix_dedup.deduplicate(docs.mapInArrow(stirred, docs.schema)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got} == want and len(got) == len(want)


def windows_by_hand(docs, items, size):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for t in docs:
        w, hit, found = pattern.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_fm_index_by_hand():
    rng = random.Random(5)
    for _ in range(80):
        words = ["a", "B", "é", "d1", "ee"][: rng.randint(1, 5)]
        make = lambda n: rng.choice([" ", ". ", "-"]).join(rng.choice(words) for _ in range(n))  # noqa: E731,B023
        docs = [rng.choice([None, "", make(60)]) if rng.random() < 0.2 else make(rng.randint(0, 80)) for _ in range(rng.randint(1, 12))]
        items = [(str(k), rng.choice([None, make(rng.randint(0, 20))])) for k in range(rng.randint(0, 6))]
        size = rng.randint(1, 10)
        shard = fm_index._Shard(fm_index.queries_of(items, size))
        shard.add(pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.string())], names=["doc_id", "text"]))
        got = next(shard.result()).to_pylist()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == windows_by_hand(docs, items, size)


def test_decontamination_in_blocks(spark):
    rng = random.Random(8)
    items = [(k, phrase(rng, 30)) for k in range(6)] + [(6, None), (7, "two words")]
    rows = [(k, phrase(rng, 40) + " " + " ".join(items[k % 6][1].split()[5:20]) + ". Two, words? " + phrase(rng, 9)) for k in range(12)] + [(20, None), (21, "clean text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {r[0]: w for r, w in zip(rows, windows_by_hand([t for _, t in rows], [(str(i), t) for i, t in items], 10), strict=True)}
    for size in (4 << 20, 200):
        got = fm_index.find_hits(table(spark, rows), bench, block_bytes=size).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    clean = fm_index.decontaminate(table(spark, rows), bench)
    assert clean.columns == table(spark, rows).columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert left[21] == ("clean text", 10) and left[20][0] is None
    again = windows_by_hand([t for t, _ in left.values()], [(str(i), t) for i, t in items], 10)
    assert not any(n for _, n, _ in again) and all(len(t or "") == n for t, n in left.values())
    assert fm_index.find_hits(table(spark, rows), bench.where("item_id > 99")).where("n_hit > 0").count() == 0


def test_decontamination_does_not_depend_on_blocks(spark):
    rng = random.Random(12)
    passages = [phrase(rng, 15).split() for _ in range(12)]
    items = [(2 * k + h, " ".join(w[5 * h : 10 + 5 * h])) for k, w in enumerate(passages) for h in (0, 1)]  # two windows of a passage share words 6 to 10
    items += [(40 + h, " ".join(f"next{h} {j}" for j in range(5))) for h in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"Before {k}, {', '.join(w)}. After") for k, w in enumerate(passages)] + [(20, " ".join(passages[0])), (21, "Left; " + "; ".join(t for i, t in items if i >= 40) + "; right"), (22, "clean text"), (23, None), (24, "")]
    rows += [(None, rows[1][1]), (None, None), (2, rows[3][1]), rows[4]]
    docs = table(spark, rows)
    assert len(fm_index.blocks_of(bench, 200)) > 3
    one, many = (sorted(map(tuple, fm_index.decontaminate(docs, bench, block_bytes=n).collect()), key=repr) for n in (4 << 20, 200))
    assert many == one and len(one) == len(rows) - 1
    assert {r[1] for r in many if r[0] in range(12)} == {f"Before {k}, . After" for k in range(12)}


def test_hits_do_not_depend_on_blocks(spark):
    rng = random.Random(13)
    items = [(k, phrase(rng, 14)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, f"é {items[0][1]}, {items[1][1]} x"), (None, items[2][1]), (None, None), (1, items[3][1]), (1, items[4][1] + " a b c"), (1, "clean"), (2, items[5][1]), (2, items[5][1]), (3, "")]
    docs = table(spark, rows)
    want = sorted(((r[0], *w) for r, w in zip(rows, windows_by_hand([t for _, t in rows], [(str(i), t) for i, t in items], 10), strict=True)), key=repr)
    one, many = (sorted(map(tuple, fm_index.find_hits(docs, bench, block_bytes=n).collect()), key=repr) for n in (4 << 20, 200))
    assert [r[:4] for r in many] == want and many == one


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 255, 4080, 4081, 255 * 255, 255 * 255 + 1, 200_000])
def test_ogg_round_trip(size):
    payload = ogg.padded(bytes(random.Random(size).randrange(256) for _ in range(size)))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, size)
    media = ogg.encode(payload)
    samples, ends = ogg.read_samples(media)
    assert samples == payload and ends[-1] == len(payload) / ogg.RATE
    assert ends == [min(k + ogg.PACKET, len(payload)) / ogg.RATE for k in range(0, len(payload), ogg.PACKET)]
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.decode(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.decode(media[:-1])


def test_ogg_checksum_by_hand():
    data = bytes(range(200))
    register = 0
    for b in data:
        register ^= b << 24
        for _ in range(8):
            register = (register << 1 ^ (0x04C11DB7 if register >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.page_crc(data) == register


def test_ogg_table(spark):
    rows = [(1, "é" * 40), (2, None), (3, ""), (1, "é" * 40), (None, "x")]
    got = ogg.ogg_digests(table(spark, rows)).collect()
    assert len(got) == 5
    for r in got:
        raw = ogg.padded((dict(rows).get(r["doc_id"]) or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    streams = ogg.ogg_streams(ogg.ogg_files(table(spark, rows))).collect()
    assert len(streams) == 10 and all(s["error"] is None for s in streams)
    assert ogg.ogg_digests(table(spark, []).where("doc_id > 0")).count() == 0


def test_folding():
    assert toxicity.fold("1D10T lоser tr4sh $cum room 42 Ünïcode") == "idiot loser trash scum room 42 ünïcode"
    assert len(toxicity.fold("İstanbul ß")) == len("İstanbul ß")


def test_lexicon_matches():
    found = toxicity.Lexicon((("trash", 2.0), ("pathe*", 1.5)), ("trash can",), (-3.0, 3.0, 1.0, 0.5))
    automaton = found.automaton()
    spans = lambda t: [(s, e) for s, e, _ in toxicity.matches(automaton, toxicity.fold(t))]
    assert spans("you trash!") == [(4, 9)] and spans("trashy") == [] and spans("the trash can") == []
    assert spans("PATHETIC tr4sh") == [(0, 5), (9, 14)]


def test_toxicity_learns(spark):
    rng = random.Random(2)
    rows = [(k, phrase(rng, 60) + (f" you are a {rng.choice(['blorg', 'zatch'])} " * 2 if k % 4 == 0 else "") + phrase(rng, 20)) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(160)] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, score int")
    docs = table(spark, [*rows, (900, None), (901, ""), (902, "bl0rg you bl0rg")])
    lexicon = toxicity.fit(docs, toxicity.learnable(labels))
    assert {"blorg", "zatch"} <= {w for w, _ in lexicon.words}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(240)) and got[902] >= 0.5 and max(got[900], got[901]) < 0.5
    assert toxicity.keep_clean(docs, lexicon).count() == 182
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.keep_clean(docs, nothing).count() == 243


def test_toxicity_keeps_all_words_that_pass(spark):
    """Of 150 long toxic words, with three starts each, none is left out."""
    rng = random.Random(21)
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}qxzvkword" for k in range(150)]
    toxic = [(k, phrase(rng, 30) + " " + " ".join(rng.sample(words, 60)) + " " + phrase(rng, 9)) for k in range(150)]
    rows = toxic + [(200 + k, phrase(rng, 60)) for k in range(150)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(table(spark, rows), labels)
    assert set(words) <= {w for w, _ in lexicon.words} and len(lexicon.words) >= 600


def test_viterbi_by_hand():
    rng = np.random.default_rng(4)
    for _ in range(60):
        k = int(rng.integers(1, 5))
        counts = rng.integers(0, 9, int(rng.integers(1, 6)))
        rows = np.repeat(np.arange(len(counts)), counts)
        scores = rng.normal(0, 2, (len(rows), k)).astype(np.float32)
        got = langid.viterbi(scores, rows, len(counts), 1.5)
        for r in range(len(counts)):
            s = scores[rows == r]
            if not len(s):
                continue
            best = s[0].astype(float)
            for t in range(1, len(s)):
                best = np.maximum(best, best.max() - 1.5) + s[t]
            path = got[rows == r]
            value = s[np.arange(len(s)), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
            assert abs(value - best.max()) < 1e-3


def test_language_spans(spark):
    rng = random.Random(3)
    words = {"xx": ["alba", "bolu", "cabo", "dalo"], "yy": ["theng", "shing", "wrang", "knigh"], "zz": ["привет", "мир", "слово", "дом"]}
    text = lambda n, k: " ".join(rng.choice(words[n]) for _ in range(k))
    rows = [(i, text(n, 40), n) for i, n in enumerate(["xx", "yy", "zz"] * 20)] + [(90, None, "xx"), (91, "123 !", None), (92, text("xx", 30) + " " + text("yy", 50), "yy"), (93, "Ω", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(langid.learnable(docs))).collect()}
    assert all(got[i]["lang_pred"] == n and 0 <= got[i]["score"] <= 1 for i, _, n in rows[:60])
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und"
    assert got[92]["lang_pred"] == "yy" and [s["lang"] for s in got[92]["spans"]] == ["xx", "yy"]
    empty = langid.fit(docs.where("doc_id < 0"))
    assert langid.identify(docs, empty).where("lang_pred != 'und'").count() == 0


def test_pii_base_and_contexts(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
        return all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 9 <= len(d) <= 15 if kind == "phone" else True

    rows = list(enumerate(["é😀 a@b.com_x@y.zz call 1.2.3.4.5.6.7.8", "4111 1111-1111 1111 2", "+1 (234) 567-890 +1 12", None, "", "1" * 20_000, "1.2.3.999 1.2.3.255", "a@b a@b.c. 😀+12 345 678 901😀", "12-" * 5000, "a.b." * 5000 + "@c.d"]))
    rows += [(100 + j, f"noise words and my phone: +1 (20{j}) 555-010{j} more") for j in range(9)] + [(200, "so my phone: 555-0177x yes"), (201, "plain 555-0177x no"), (0, rows[0][1])]
    got = pii.find_personal_data(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = [(k, m.start(), m.end()) for k in kinds for m in re.finditer(kinds[k], texts[r["doc_id"]] or "") if valid(k, m[0])]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == want
        added = [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"] if not s["base"]]
        assert added == ([("phone", "555-0177x")] if r["doc_id"] == 200 else [])
    assert pii.find_personal_data(table(spark, []).where("doc_id > 0")).count() == 0


def test_pii_words_before_a_mention_are_whole(spark):
    """However much space pads them, and however long they are."""
    long = "w" * 30_000
    befores = ["", " ", "one ", "My Phone: ", "my phone:" + " " * 200, "a\tmy" + "\t\n \r" * 50 + "phone: ", f"so {long} {long} ", f"x {long}y \n", "é" * 90 + " 😀ß ", " " * 300]
    rows = [(k, t + "+1 (201) 555-0101") for k, t in enumerate(befores)]
    docs = pii.keyed(table(spark, rows))
    key = {r["key"]: r["doc_id"] for r in docs.collect()}
    got = {key[r["key"]]: (r["w2"], r["w1"]) for r in pii.mentions(docs).where("kind = 'phone'").collect()}
    assert got == {k: tuple(["", "", *re.findall("[^ \n\t\r]+", t.lower())][-2:]) for k, t in enumerate(befores)}
    rows = [(j, f"noise words and my {' ' * 100}phone:{' ' * 100}+1 (20{j}) 555-010{j} more") for j in range(9)] + [(20, f"so my phone:{' ' * 90}555-0177x yes")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert [rows[9][1][s["start"] : s["end"]] for s in found[20]] == ["555-0177x"]


def test_secret_decoding_by_hand():
    rng = np.random.default_rng(2)
    for _ in range(100):
        pairs, first = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
        pairs[0, 2] = first[2] = secrets_crf.NEVER
        model = secrets_crf.Model(np.zeros((1, 3)), pairs, first)
        rows = np.sort(rng.integers(0, 4, 12))
        scores = rng.normal(0, 3, (12, 3))
        scores[:, 0] += rng.choice([0, 40], 12)
        got = secrets_crf.decode(secrets_crf.Model(np.array([[0.0, 9.0, 0.0]]), pairs, first), scores, rows)
        for r in np.unique(rows):
            s, path = scores[rows == r], got[rows == r]
            best = first + s[0]
            for t in range(1, len(s)):
                best = (best[:, None] + pairs).max(0) + s[t]
            value = first[path[0]] + s[np.arange(len(s)), path].sum() + pairs[path[:-1], path[1:]].sum()
            assert abs(value - best.max()) < 1e-6
        del model


def test_secret_features_of_long_texts():
    """Counts of 4,096 and more do not wrap: the file's share of digits, and the share and kind of long tokens."""

    def of(text):
        data, offsets = secrets_crf.text_bytes(pa.array([text]))
        return (secrets_crf.features(data, offsets, *secrets_crf.tokens(data, offsets)) - secrets_crf.STARTS[:-1]).tolist()

    group = {"share": 1, "upper": 2, "kind": 3, "file": 7}
    for n in (100, 4095, 4100, 9000):
        assert {t[group["file"]] for t in of("12 ab " * (n // 2))} == {4}
        for text, share, upper, kind in (("7" * n, 4, 0, 0), ("a" * n, 0, 0, 1), ("z" * n, 0, 0, 2), ("Z" * n, 0, 3, 2), ("a1" * n, 3, 0, 1)):
            assert [of(text)[0][group[k]] for k in ("share", "upper", "kind")] == [share, upper, kind]


def test_secrets(spark):
    rng = random.Random(6)
    token = lambda n, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(n))
    mixed = "0123456789abcdefABCDEFXYZ"
    rows = [(k, phrase(rng, 30) + f' {rng.choice(["token", "api_key", "secret", "Password"])} = "{token(40) if k % 2 else token(36, mixed)}" ' + phrase(rng, 30)) for k in range(60)] + [(k, phrase(rng, 60)) for k in range(60, 90)]
    odd = 'credential = "' + token(38, mixed) + '" '
    rows += [(100, None), (101, ""), (102, phrase(rng, 9) + " " + odd + phrase(rng, 9)), (103, "AKIA" + "A" * 16 + " AKIAAKIA token:token\"=abcdef123 secret='12345' PASSWORD: hunter2x é"), (0, rows[0][1])]
    docs = table(spark, rows)
    model = secrets_crf.fit(docs)
    got = secrets_crf.find_secrets(docs, model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    kinds = {"assign": r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    for r in got:
        t = texts[r["doc_id"]] or ""
        want = [(k, m.start(), m.end()) for k in kinds for m in re.finditer(kinds[k], t) if (len(m[2]) >= 6 if k == "assign" else len(m[0]) >= (20 if k == "access" else 24))]
        assert [tuple(s) for s in r["spans"] if s["kind"] != "crf"] == sorted(want, key=lambda x: (x[1], list(kinds).index(x[0])))
        if 60 <= (r["doc_id"] or 0) < 90:
            assert not r["spans"]
        if r["doc_id"] == 102:
            assert any(s["kind"] == "crf" and t[s["start"] : s["end"]] in odd for s in r["spans"])
    clean = secrets_crf.redact(docs, model)
    assert clean.columns == docs.columns and clean.where("doc_id < 60 and (text not like '%[SECRET]%' or n_chars != length(text))").count() == 0
    assert secrets_crf.fit(docs.where("doc_id < 0")).weights.shape[1] == 3


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixture.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9))).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in rest}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixture(spark):
    rng = random.Random(7)
    rows, sources = [], []
    for k in range(400):
        rows.append((k, phrase(rng, rng.randrange(200))))
        sources.append(rng.choice(["a"] * 6 + ["b", "b", "c", None, "é", "Z"]))
    rows += [(500, None), (501, ""), (None, "x y z"), (0, rows[0][1])]
    sources += ["a", "empty", "b", sources[0]]
    docs = table(spark, rows, sources)
    got = mixture.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, mixture.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    sizes = Counter()
    for (_, t), s in zip(rows, sources, strict=True):
        sizes[s] += len((t or "").split())
    want = targets_by_hand(sizes)
    taken = Counter()
    source_of = {i: s for (i, _), s in zip(rows, sources, strict=True)}
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixture.BLOCK for s in sizes)
    assert mixture.mix(docs.where("doc_id < 0")).count() == 0


def test_warc(spark):
    etag = [("ETag", '"a"'), ("Cache-Control", "max-age=1"), ("X-Kept", "1")]
    data = b"".join([
        warc.record("response", "r1", "http://WWW.a.com:80/x/?b=2&utm_source=q&a=1#f", 10, etag, b"one"),
        warc.record("revisit", "v0", "https://a.com/x?a=1&b=2", 10, [("ETag", '"a"')]),
        warc.record("response", "r2", "https://a.com/x?a=1&b=2", 9000, [("ETag", '"b"')], b"two"),
        warc.record("revisit", "v1", "https://a.com/x?a=1&b=2", 20, [("ETag", 'W/"a"'), ("Cache-Control", "max-age=9"), ("Content-Length", "0"), ("X-Kept", "2")]),
        warc.record("revisit", "v2", "https://a.com/x?a=1&b=2", 9500, [("ETag", '"b"')]),
        warc.record("revisit", "v3", "https://a.com/x?a=1&b=2", 99999, [("ETag", '"a"')]),
        warc.record("revisit", "v4", "https://b.com/", 99999, []),
    ])
    files = spark.createDataFrame([(data,), (data[:50],), (None,)], "content binary")
    records = warc.read_records(files)
    assert records.where("error is not null").count() == 1
    got = {r["record_id"]: r for r in warc.resolve(records).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"r1": "full", "r2": "full", "v0": "unresolved", "v1": "resolved", "v2": "resolved", "v3": "mismatch", "v4": "unresolved"}
    assert got["v1"]["refers_to"] == "r1" and got["v1"]["body_sha256"] == hashlib.sha256(b"one").hexdigest()
    assert got["v1"]["headers"] == {"etag": 'W/"a"', "cache-control": "max-age=9", "x-kept": "1"}
    assert got["v3"]["refers_to"] == "r2" and got["v3"]["body_sha256"] is None
    assert got["v1"]["canonical_url"] == "a.com/x?a=1&b=2"


@HERE
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_table(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    source = "pages" if name == "op10_warc" else "documents"
    want = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    assert df.count() == want * (2 if source == "pages" else 1)


@HERE
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    compare(spark, queries.QUERIES, queries.ORACLES, name)


def test_warc_dates_members_and_resynchronising():
    import gzip

    assert [warc.seconds_of(d) for d in ("1970-01-01T00:00:01Z", "1970-01-01T00:01:00.25Z", "1970-01-02", "1970-02", "1971", "1970-01-01T01:00Z")] == [1, 60, 86400, 31 * 86400, 365 * 86400, 3600]
    for bad in ("1970-13-01", "1970-02-30", "x", "1970-01-01T24:00:00Z"):
        with pytest.raises(ValueError):
            warc.seconds_of(bad)
    one = lambda k: warc.record("response", f"r:{k}", "http://a/", k, [("A", "b")], b"body")
    fraction = one(5).replace(b"00:00:05Z", b"00:00:05.75Z")
    assert [(r["record_id"], r["seconds"]) for r in warc.parse(one(1) + fraction)] == [("r:1", 1), ("r:5", 5)]
    wrong = one(2).replace(b"body", b"bodx")
    got = list(warc.parse(one(1) + wrong + one(3) + b"junk" + one(4)))
    assert [r["record_id"] for r in got] == ["r:1", None, "r:3", None, "r:4"]
    zipped = gzip.compress(one(1)) + gzip.compress(one(2))
    assert [r["record_id"] for r in warc.parse(zipped)] == ["r:1", "r:2"]
    assert [r["record_id"] for r in warc.parse(gzip.compress(one(1)) + b"\x1f\x8b\x08broken" + gzip.compress(one(2))) if r["record_id"]] == ["r:1", "r:2"]
    assert list(warc.parse(b"")) == []


def test_captures_of_odd_pages(spark):
    rows = [(1 << 40, "http://a.b/c", "x"), (None, "http://a.b/c", "x"), (3, None, None), (3, None, None)]
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, status string, seconds int")
    got = warc.resolve(warc.read_records(warc.captures(pages))).collect()
    assert len(got) == 8 and sum(r["status"] == "full" for r in got) == 4
    assert warc.resolve(warc.read_records(warc.captures(pages.where("false")))).count() == 0


def test_secret_windows_do_not_depend_on_batches(spark):
    rng = random.Random(9)
    rows = [(k, phrase(rng, rng.randint(0, 200)) + (f" password = hunter{k}secret99 " if k % 5 == 0 else "") + phrase(rng, 30)) for k in range(80)]
    docs = table(spark, rows)
    one, two = (secrets_crf.fit(d) for d in (docs.coalesce(1), docs.repartition(7)))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.pairs, two.pairs) and np.array_equal(one.first, two.first)
    few = secrets_crf.fit(table(spark, [(1, "password = abcdef123456")]))
    assert np.abs(few.weights).max() > 0.1


def test_small_sources_meet_their_targets(spark):
    rows = [(k, "w " * 10) for k in range(6)] + [(100 + k, "v " * 500) for k in range(40)]
    got = mixture.mix(table(spark, rows, ["a"] * 3 + ["b"] * 3 + ["c"] * 40)).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[round(r["target"], 6), r["source_size"]] += r["taken"]
    assert all(abs(n - t * (2 if s == 30 and t == 60.0 else 1)) <= max(2, 0.02 * t) for (t, s), n in by_target.items())


@HERE
def test_held_out_languages_are_told(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = queries.op5_langid(spark, str(DATA)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


@HERE
def test_held_out_toxicity_is_told(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op2_toxicity(spark, str(DATA)).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    assert rows and sum(int(r["toxic"]) == r["predicted"] for r in rows) >= 0.9 * len(rows)
