"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import chat, jaccard_join, mixing, near_vectors, packing, secrets, substring_dedup, topk, toxicity, url_filter
from ledgerline.llm.queries import URL_RULES
from ledgerline.llm.url_labels import labelled_words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(n)]
    for i in range(0, n - 20, 3):  # near copies, shared passages
        w = texts[i].split()
        if w:
            w[rng.randrange(len(w))] = "Changed"
        texts[i + 15] = " ".join(w) if i % 2 else texts[i + 15] + "\n" + texts[i][:150]
    texts += [None, "", "one two", "one two", "\t x y \n", "z " * 3000, texts[5], texts[5]]
    return [(i, t, f"s{i % 3}" if i % 7 else None, "x", 1.5) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, source string, block string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def root(up, x):
    while up[x] != x:
        x = up[x]
    return x


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(docs, nothing, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and (k := len(sets[a] & sets[b])) and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = root(up, a), root(up, b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n, percent).collect()}
    assert got == {i: (len(s), root(up, i)) for i, s in sets.items()}
    assert jaccard_join.jaccard_components(nothing, n, percent).count() == 0


def test_jaccard_large_cells(docs, monkeypatch):
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs, 3, 80).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, 3, 80).collect())) == want


def test_substring(docs, nothing):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in corpus()}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.kept_words(substring_dedup.find_repeats(docs)).collect()}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
        for f in got[i].factors:  # true passages of the document named, at the place named
            assert f.words >= 13 and f.doc_id < i and w[f.start : f.start + f.words] == words[f.doc_id][f.place : f.place + f.words]
    assert substring_dedup.find_repeats(nothing).count() == 0


def test_packing(docs, nothing):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs.union(docs.limit(3)), RANKS, size=64).collect()
    texts = {i: x for i, x, *_ in corpus()}
    by, seqs = defaultdict(dict), defaultdict(list)
    for r in rows:
        by[r.doc_id][r.piece] = r
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        got = [n for k in sorted(by[i]) for n in np.frombuffer(by[i][k].ids, "<u4").tolist()]
        assert got == ids and all(by[i][k].length == 64 for k in by[i] if k) and len(by[i]) == -(-len(ids) // 64)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seqs) <= 1.02 * -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack_documents(nothing, RANKS, size=64).count() == 0


@pytest.mark.parametrize("text", ["don't  stop\n\n\n now", "a<|endoftext|>b", "  　x y \r\n 12ab٣", "ÀÉ'LL it's", "\x00\x1f z", "🙂🙂 👩‍👧"])
def test_encoder_is_the_tokenizer(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(RANKS, (("<|endoftext|>", 50256),))(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_mixing(docs, nothing):
    rows = mixing.mix_sources(docs, share=1.5, cap=2.0).collect()
    again = mixing.mix_sources(docs, share=1.5, cap=2.0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus()}
    assert {r.doc_id: r["size"] for r in rows} == size
    of = defaultdict(list)
    for r in rows:
        of[r.source].append(r)
    total, weight = sum(size.values()), {s: w for s, w in zip(sorted(of, key=lambda s: (s is None, s)), (5, 2, 1, 5), strict=True)}
    cap = {s: 2 * sum(r["size"] for r in x) for s, x in of.items()}
    target, free = {}, set(of)
    while True:
        level = (1.5 * total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s, x in of.items():
        assert x[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in x) - target[s]) <= max(size.values())
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in x)
    assert mixing.mix_sources(nothing).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(2)
    x[50:80] = x[20] + rng.normal(size=(30, 8)) * 0.08
    x[80:90] = x[10]
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    return rows + [(300, None, 1), (301, [float("nan")] * 8, 1), (302, [0.0] * 8, 1), (303, [1.0, None], 0), (304, [1.0, 2.0], 0), (305, [1.0, 2.0], None), (306, [], 0), (307, [2.0, 4.0], 0)]


def test_near_vectors(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(x, float), label) for i, x, label in vectors() if x and None not in x and np.isfinite(x).all() and np.any(x) and label is not None}
    up, links = {i: i for i, *_ in vectors()}, defaultdict(int)
    for a, (x, p) in good.items():
        for b, (y, q) in good.items():
            if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                u, v = root(up, a), root(up, b)
                up[max(u, v)] = min(u, v)
    for extra in ({}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 500, "block_rows": 7}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df, 0.98, **extra).collect()}
        assert got == {i: (links[i], root(up, i), root(up, i) == i) for i in up}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_with_ties_and_repeats(spark):
    """Vectors at one distance from each other, a long chain of close ones, repeated rows, a null id, clashing names."""
    rows = [(i, [float(i == j) for j in range(60)], 1) for i in range(60)] + [(100 + i, [1.0, 0.05 * i], 0) for i in range(80)] + [(None, [1.0, 2.0], 0), (300, [1.0, 2.0], 2), (300, [1.0, 2.0], 2), (301, [2.0, 4.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    got = near_vectors.near_vectors(df, 0.98, cell_rows=30, block_rows=8).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].kept for i in range(60))
    assert {by[100 + i].component_id for i in range(80)} == {100}
    assert (by[300].n_links, by[301].n_links, by[301].component_id) == (1, 1, 300)
    assert (by[None].n_links, by[None].component_id) == (0, None)


def test_top_k(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    good = {i: np.floor(256 * np.array(x)) for i, x, _ in vectors() if x and None not in x and np.isfinite(x).all()}
    want = set()
    for i in (j for j in good if j % 50 == 0):
        best = sorted((-int(good[i] @ y), j) for j, y in good.items() if j != i and len(y) == len(good[i]))[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    for extra in ({}, {"shard_rows": 40, "sample_rows": 100}):
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, **extra).collect()} == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("extra", [{}, {"shard_rows": 40, "sample_rows": 100, "query_rows": 3}])
def test_top_k_is_exact_beyond_doubles(spark, extra):
    rng = np.random.default_rng(1)
    rows = [(0, [70000.0, 1.0]), (1, [80000.0, 0.0]), (2, [90000.0, 0.0]), (5, [1e300, 1e300]), (6, [1e299, -3.0]), (50, [1e300, -1e300]), (100, [0.0, 0.0]), (7, [80000.0, 0.0]), (7, [80000.0, 0.0])]
    rows += [(i + 10, [float(c) for c in rng.normal(size=8) * 10.0 ** rng.integers(0, 10)]) for i in range(300)]
    rows += [(i + 500, [1.0] * 8) for i in range(100)] + [(750, [1e9 + i for i in range(8)])]
    whole = lambda c: int(c) * 256 if abs(c) >= 2**52 else int(np.floor(256 * c))
    asked, want = {}, set()
    for i, x in {(i, tuple(map(whole, x))) for i, x in rows}:
        if i % 50 == 0:
            asked.setdefault(i, set()).update((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in {(j, tuple(map(whole, y))) for j, y in rows} if j != i and len(y) == len(x))
    for i, c in asked.items():
        want |= {(i, n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(sorted(c)[:5])}
    df = spark.createDataFrame([*rows, (None, [1.0, 2.0]), (8, [])], "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("dim", F.lit(1)).withColumn("asks", F.lit(None))
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, **extra).collect()} == want


def test_secrets(spark):
    live = "Zq8rT2xWm9Kp4LbV7cNs1Yd3"
    shared = "Aa1bB2cC3dD4eE5fF6gG7h"
    texts = [(1, f"é token = 'abcdefgh12' AKIA{'A1B2' * 4} x {'0af9' * 9}", "a"), (2, f"key {live} Password:short", "a"), (3, f"ex {shared} api-key", "a"), (4, f"ex {shared}", "b"), (5, None, None), (5, "", "c"), (6, "w " * 40000 + live, "a")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = secrets.scan_secrets(df).collect()
    got = {(r.doc_id, s.kind, s.start, s.end) for r in rows for s in r.spans}
    assert got == {(1, "assign", 2, 21), (1, "access", 23, 43), (1, "hex", 46, 82), (2, "live", 4, 4 + len(live)), (6, "live", 80000, 80000 + len(live))}
    assert {(s.repositories, s.owners, s.status) for r in rows for s in r.spans if r.doc_id in (2, 6)} == {(2, 1, "live")}
    assert secrets.scan_secrets(df.limit(0)).count() == 0
    assert secrets.redact("ab secret cd", [(3, 9), (4, 6)]) == "ab [SECRET] cd"


def test_secret_counts_are_distinct(spark):
    """A repository with two owners is one repository; repeated rows count once; columns of any name pass."""
    value = "Zq8rT2xWm9Kp4LbV7cNs1Yd3"
    rows = [(1, f"k {value}", "a"), (1, f"k {value}", "b"), (2, f"k {value}", "a"), (2, f"k {value}", "a"), (3, f"k {value}", None), (None, f"k {value}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("row", "found", "hash", "kind", "repository", "owner", "kept", "block", "status")
    for c in names:
        df = df.withColumn(c, F.lit(c))
    got = secrets.scan_secrets(df, keep=("doc_id", *names), shared=5).collect()
    assert len(got) == len(rows) and {(s.repositories, s.owners) for r in got for s in r.spans} == {(4, 3)}
    assert all(r[c] == c for r in got for c in names)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    odd = ["<|im_end|>\n", "\\", "<\\|im_start|>", "hi <|im_sep|> é 🙂", "", None, "a <|", "w " * 40]
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", None]), "".join(filter(None, rng.choices(odd, k=2))) or None) for c in range(6) for t in range(30 if c else 700)]
    back = {r.conv_id: r for r in chat.read_back(chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=50)).collect()}
    for c in range(6):
        own = [r for r in rows if r[0] == c]
        assert back[c].n_turns == len(own)
        assert back[c].said == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert back[c].learned == "".join(r[3] or "" for r in own if r[2] == "assistant")


@pytest.mark.parametrize(("budget", "history"), [(50, 2), (7, 1), (512, 0), (120, 5)])
def test_chat_windows_fit_the_budget(spark, budget, history):
    rng = random.Random(7)
    rows = [(c, t if c != 3 else 0, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 3, 9, 30, 80])) for c in range(5) for t in range(60)]
    rows += [(None, None, None, None), (9, 1, "assistant", "x " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("tokens", F.lit(1))
    tokens = lambda x: max(1, len(WORD.findall(x or "")))
    system = {c: tokens(x) for c, t, r, x in rows if r == "system" and t == 0}
    for w in chat.chat_windows(df, budget, history).collect():
        new = w.formatted.count("<|im_end|>") - w.repeated
        assert w.repeated <= history + 1
        if w.tokens > budget:  # a single turn that is longer than what the system turn and the reserve leave, without history
            assert new == 1 or (new == 2 and w.window == 0)
            assert w.repeated <= (w.conv_id in system)
    back = {r.conv_id: r for r in chat.read_back(chat.chat_windows(df, budget, history)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        assert back[c].said == "".join(f"{r}\n{x}\n" for _, r, x in own)
        assert back[c].learned == "".join(x for _, r, x in own if r == "assistant")
    assert chat.chat_windows(df.limit(0), budget).count() == 0


def test_urls(spark):
    urls = ["http://a.COM/x?q", "https://example.com/en/1", "https://www.example.com/en/2#t", "http://m.x.net/fr/", "http://b.org/de/3", "noscheme.com/", None, "http://", "http://xcom/", "http://h.com?a/b", "http://p.net/es/" + "y" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    assert url_filter.filter_urls(pages.limit(0), URL_RULES, model).count() == 0
    twice = url_filter.filter_urls(pages.union(pages), URL_RULES, model)
    assert twice.count() == 2 * len(urls) == 2 * twice.distinct().count()
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(pages, URL_RULES, model).collect()}
    assert got[0] == ("a.com", "/x", "com/") and got[1] == ("example.com", "/en/1", "example.com/en/") and got[2][2] == "www.example.com/en/"
    assert got[3][2] == "net/fr/" and got[4] == ("b.org", "/de/3", None) and got[5] == ("", "", None) and got[6] == ("", "", None)
    assert got[8][2] is None and got[9] == ("h.com", "", None) and len(got[10][1]) == 5004


@pytest.mark.parametrize("part", range(3))
def test_url_model_on_words_it_has_not_seen(spark, part):
    """Every third word, with all of its urls, is held out: its family's letters and its pages tell."""
    rows = labelled_words()
    held = {w for i, w in enumerate(dict.fromkeys(w for w, _, _ in rows)) if i % 3 == part}
    model = url_filter.train_url_model(spark.createDataFrame([r[1:] for r in rows if r[0] not in held], "url string, label int"))
    scored = url_filter.score_urls(url_filter.parse_urls(spark.createDataFrame([r[1:] for r in rows if r[0] in held], "url string, label int")), model).collect()
    share = lambda label: np.mean([(r.block_score >= 0.5) == label for r in scored if r.label == label])
    assert len(scored) > 500 and share(1) >= 0.7 and share(0) >= 0.88


def test_paths_tell_the_url_model(spark):
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    urls = ["http://example.org/wiki/history", "http://example.org/casino-bonus/free-spins", "http://plainhost.org/article/7", "http://plainhost.org/download/crack/7"]
    got = {r.i: r.block_score for r in url_filter.score_urls(url_filter.parse_urls(spark.createDataFrame(list(enumerate(urls)), "i int, url string")), model).collect()}
    assert got[0] < 0.5 <= got[1] and got[2] < 0.5 <= got[3]


def test_url_model_learns(spark):
    rows = [(f"http://{'casino' if i % 2 else 'school'}{i}.org/{'win' if i % 2 else 'class'}/{i}", i % 2) for i in range(60)]
    model = url_filter.train_url_model(spark.createDataFrame(rows, "url string, label int"))
    scored = url_filter.score_urls(url_filter.parse_urls(spark.createDataFrame([("http://casinox.org/win/a",), ("http://schoolx.org/class/b",)], "url string")), model)
    assert [r.block_score > 0.5 for r in scored.orderBy("host").collect()] == [True, False]


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgnorst") for _ in range(5))
    text = lambda bad, n: " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate([*(word() for _ in range(n)), *(["you", rng.choice(["moron", "idiot"])] if bad else []), *(word() for _ in range(5))])) + "."
    labelled = [(text(i % 4 == 0, 700 if i % 10 == 0 else 30), int(i % 4 == 0)) for i in range(400)]
    return toxicity.train_toxicity(spark.createDataFrame(labelled, "text string, toxic int")), text


def test_toxicity_tolerates_obfuscation(spark, toxic_model):
    model, text = toxic_model
    asked = [*(text(True, 30) for _ in range(5)), text(True, 3000), "fine sted abcde you m.o.r.o.n", "what i d i o t sad", "so i---------d---------i---------o---------t he", "what 1d1ot he", text(False, 30), text(False, 3000), None, "", " .,! "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string")
    got = [r.toxicity for r in toxicity.score_toxicity(df.withColumn("toxicity", F.lit("clash")), model).orderBy("i").collect()]
    assert all(s >= 0.7 for s in got[:10]) and all(s < 0.7 for s in got[10:])
    twice = toxicity.score_toxicity(df.union(df), model)
    assert twice.count() == 2 * len(asked) and twice.distinct().count() == len(asked)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_signs_change_no_margin_whatever_the_length(toxic_model):
    model, _ = toxic_model
    words = ["idiot", "i.d.i.o.t", "id-iot", "-".join("idiot"), *((sign * n).join("idiot") for sign in "-._*" for n in (3, 9, 40, 400))]
    assert len({round(float(m), 6) for m in model.margins(words)}) == 1
    assert model.margins(["x" * 300 + "idiot" + "y" * 300])[0] > model.margins(["x" * 300 + "abcde" + "y" * 300])[0]


def test_a_spelled_insult_counts_at_every_place(toxic_model):
    model, _ = toxic_model
    worst = []
    for at in range(200):
        words = ["stone"] * 200
        words[at:at] = list("idiot")
        tokens, sizes = toxicity.sentences(" ".join(words))
        assert tokens.count("idiot") == 1 and sum(sizes) == len(tokens)
        worst.append(float(model.margins(tokens).max()))
    assert max(worst) - min(worst) < 1e-9


def test_margins_do_not_jump_where_forms_are_read_in_windows(toxic_model):
    model, _ = toxic_model
    steps = [np.abs(np.diff(model.margins([(s * 20)[:n] for n in range(30, 56)]))) for s in ("idiot", "qwertzuiop", "aab", "harmless")]
    for s in steps:
        assert s[10] < 0.1 + 3 * s[:10].max()  # from 40 to 41 letters


def test_string_kernel_is_brute_force():
    """The hashed kernel of two words equals the sum over common gapped subsequences of three characters."""

    def whole(w):
        w, out = f"^{w}$", defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + 3 + toxicity.GAP)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "i.d.i.o.t", "idiom", "table", "id-iot"]
    dense = toxicity._dense(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = whole(a), whole(b)
            norm = lambda v: sum(c * c for c in v.values()) ** 0.5
            want = sum(c * y[g] for g, c in x.items() if g in y) / (norm(x) * norm(y))
            assert float(dense[i] @ dense[j]) == pytest.approx(want, abs=0.02)  # few of 2^14 slots meet


def test_toxicity_without_both_classes(spark):
    none = spark.createDataFrame([], "text string, toxic int")
    assert toxicity.train_toxicity(none) is None
    one = toxicity.train_toxicity(spark.createDataFrame([("all fine here", 0), (None, 1)], "text string, toxic int"))
    assert one is None
    assert [r.toxicity for r in toxicity.score_toxicity(spark.createDataFrame([("idiot",)], "text string"), None).collect()] == [0.0]


def test_the_machine_is_fitted_in_a_task(spark, monkeypatch):
    def here(*_):
        raise AssertionError("the driver fits the machine")

    monkeypatch.setattr(toxicity, "_fit_machine", here)
    labelled = [(f"a quiet text of number {i}", 0) for i in range(40)] + [(f"you moron number {i}", 1) for i in range(40)]
    model = toxicity.train_toxicity(spark.createDataFrame(labelled, "text string, toxic int"))
    assert model.vector.shape == (toxicity.SLOTS,) and model.vector.any() and np.isfinite(model.curve).all()


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated rows and ids, empty tables and columns with the stages' own names."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    other = "a text of its own with one two three four five six words more"
    extra = spark.createDataFrame([(5, other, "en", "x", 3), (5, other, "en", "x", 3), (5, None, None, None, None), (None, "no id", "en", "x", 2), (None, None, None, None, None), (7, "", None, None, 0)], docs.schema)
    docs = docs.union(extra)
    for c in ("node", "one", "key", "cuts", "times", "least", "more", "nth", "toxicity"):
        docs = docs.withColumn(c, F.lit(c))
    count = docs.count()
    for name, work in p.STAGES:
        out = work(spark, docs, d)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and all(r.nth == "nth" for r in rows)
        if name == "secrets":
            assert len(rows) == count
        if name == "near_duplicates":
            assert sum(r.text == other for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 7 and r.text == "" for r in rows) == 1
        assert work(spark, docs.limit(0), d).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = p.drop_near_duplicates(spark, docs.union(docs.limit(5)), d)
    groups = jaccard_join.jaccard_components(docs, 5, 80)
    assert {r.doc_id for r in clean.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    of = {r.doc_id: r.component_id for r in groups.collect()}
    assert sorted(of[r.doc_id] for r in clean.select("doc_id").collect()) == sorted(set(of.values()))
    redacted = p.redact_secrets(spark, docs, d)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    texts = {r.doc_id: r for r in docs.collect()}
    for r in redacted.collect():
        assert r.n_chars == len(r.text) or r.text == texts[r.doc_id].text
    assert p.run(spark, d).count() > 0
    assert hashlib.sha256  # the digests of the registered queries are SQL's
