"""The training-data operators against brute force, on rows with nulls, blanks, copies, repeats and long texts."""

import hashlib
import random

from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.llm import chat, decontamination, fingerprints, html, jaccard, language, packing, quality, queries, substrings, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, _key string"


def _rows():
    random.seed(3)
    vocabulary = ["w%d" % i for i in range(300)]

    def prose(n):
        return " ".join(random.choice(vocabulary) for _ in range(n))

    base, passage = prose(200), prose(60)
    texts = [None, "", " \t\n", "one", "one two", "One TWO", base, base, base + " tail", base.replace("w1 ", "w2 ", 1), prose(3000)]
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(4)] + [prose(30) for _ in range(6)] + ["### %%% 123"]
    texts += [passage[:300] + " " + passage[:300]]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, None, "x", "k") for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base, None, None, 5, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_near_duplicates(docs, size, percent):
    rows = [(r[0], r[1]) for r in _rows() if r[0] is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, _sets(t, size)) for i, t in rows]
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    wanted = Counter((i, len(s), root(i)) for i, s in sets)
    found = Counter(tuple(r) for r in jaccard.near_duplicates(docs, size, percent).collect())
    assert {k: n for k, n in found.items() if k[0] is not None} == dict(wanted)
    assert [k[2] for k in found if k[0] is None] == [None]


def test_substrings(docs):
    window, rows = 35, [(r[0], r[1]) for r in _rows()]
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    wanted = []
    for (doc, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        wanted.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    found = substrings.removed(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, found)) == Counter(wanted)


def test_substring_stage_keeps_columns(spark, docs):
    out = substrings.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert out.filter("doc_id in (6, 7)").count() == 0
    assert out.filter("doc_id in (0, 1, 2)").count() == 3


def test_packing(docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack(docs, size=64, window_sequences=4).collect()
    held, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in {(r[0], r[1]) for r in _rows()}:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(r[0] == doc for r in _rows())
        pieces = held[doc]
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        assert all(p["ids"] == ids[p["start"] : p["start"] + p["length"]].tobytes() for p in pieces)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("sizes,weights", [([1000, 300, 7], [10, 3, 1]), ([50, 50, 900], [1, 5, 2]), ([3], [1])])
def test_schedule_fills_every_window(sizes, weights):
    schedule = packing.Schedule(sizes, weights, 64)
    ranks = [schedule.rank(np.full(n, q), np.arange(n)) for q, n in enumerate(sizes)]
    assert sorted(np.concatenate(ranks)) == list(range(sum(sizes)))
    for window in range(sum(sizes) // 64 + 1):
        used, _ = schedule.cut(window)
        assert used.tolist() == [int((r < window * 64).sum()) for r in ranks]


def test_tokenizer_agrees_on_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer, ours = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.Tokenizer()
    tokenizer.encode_special_tokens = True
    for text in ("a  b\n\n c", "x\x1cy", "²³ 1½", "日本語 text", "it's we'LL", "__a_b", "<|endoftext|>", " é\u0085", "tab\t\tend  "):
        assert np.frombuffer(ours.encode(text), np.uint16).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_schedule_equals_brute_force():
    rng = random.Random(2)
    for queues, most in ((1, 9), (40, 5), (300, 2**31 - 1), (700, 1000)):
        sizes = [rng.choice([1, 3, rng.randrange(1, 200)]) for _ in range(queues)]
        weights = [rng.choice([1, most, rng.randrange(1, most + 1)]) for _ in sizes]
        order = sorted((Fraction(2 * j + 1, w), q, j) for q, (n, w) in enumerate(zip(sizes, weights)) for j in range(n))
        schedule = packing.Schedule(sizes, weights, 64)
        assert schedule.rank(*np.array([(q, j) for _, q, j in order[::7]]).T).tolist() == list(range(len(order)))[::7]
        assert all(schedule.window_of(q, j) == i // 64 for i, (_, q, j) in enumerate(order))
        for window in range(len(order) // 64 + 2):
            wanted = np.bincount([q for _, q, _ in order[: window * 64]], minlength=queues) if window else np.zeros(queues)
            assert schedule.cut(window)[0].tolist() == wanted.tolist()


def test_schedule_of_large_sizes():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 10**12) for _ in range(500)] + [10**12] * 3
    schedule = packing.Schedule(sizes, [max(1, round(n / 10**12 * packing.WEIGHT)) for n in sizes[:-1]] + [1], 1 << 17)
    for window in [0, 1, *(rng.randrange(schedule.total >> 17) for _ in range(50)), schedule.total >> 17, (schedule.total >> 17) + 1]:
        goal, used = min(window << 17, schedule.total), schedule.cut(window)[0]
        assert used.sum() == goal
        queues = np.arange(len(sizes))
        assert (schedule.rank(queues, np.maximum(used - 1, 0)) < goal)[used > 0].all()
        assert (schedule.rank(queues, used) >= goal)[used < sizes].all()


def test_packing_keeps_many_sources_apart(spark):
    rows = [(i, "word " * 40, f"s{i % 300}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    found = packing.pack(docs, {"s7": 0.5, "s8": 0.5}, size=64, window_sequences=4).collect()
    assert all(r["source"] == f"s{r['doc_id'] % 300}" for r in found)
    first = Counter()
    for r in found:
        first[r["source"]] += r["length"] if r["window_id"] == 0 else 0
    assert abs(first["s7"] - first["s8"]) <= 1 and first["s7"] + first["s8"] > 200


def test_tokenizer_agrees_on_the_added_token():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer, ours = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.Tokenizer()
    end = "<|endoftext|>"
    for text in (end, f"one {end} two", f"{end}{end} a", f"日本 {end}\n\n²", f"a  {end}  b", "<|endoftext|", "<|<|endoftext|>|>", "a  b"):
        assert np.frombuffer(ours.encode(text), np.uint16).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>\\", "a<|", "<", None, "", "<|im_start|>user\nhi<|im_end|>\n", "plain\ntext", "<\\\\|x"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(5) for t, role in enumerate(["system", "user", "assistant", "a\nb\\n<|", None])]
    rows += [(None, 1, "assistant", "x"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns.repartition(3))).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(found) == set(groups)
    for conv, turns_ in groups.items():
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns_)
        learnt = "".join(r[3] or "" for r in turns_ if r[2] == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns_), hashlib.sha256(every.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_url_rules(spark):
    rows = [
        ("https://A.example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://other.org/", "other.org", "/", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/a#b", "x.com", "/de/a", "com/de/", "block"),
        ("http://x.org", "x.org", "", None, None),
        ("no address", "", "", None, None),
        (None, "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id bigint, url string, host string").drop("host")
    found = urls.judge(pages, ([0.0] * urls.BUCKETS, -1.0)).orderBy("page_id").collect()
    for r, wanted in zip(found, rows):
        assert (r["host"], r["path"], r["rule"]) == wanted[1:4]
        assert r["verdict"] == (wanted[4] or "allow")


def test_fingerprints(docs):
    rows = sorted([(r[0] if r[0] is not None else -1, r[1] or "") for r in _rows()])
    found = fingerprints.edited_fingerprints(docs).collect()
    assert len(found) == len(rows)
    wanted = Counter()
    for k, (doc, text) in enumerate(rows):
        following, cut = rows[(k + 1) % len(rows)][1], len(text) // 4
        wanted[doc, len(text), text[: len(text) - cut] + following[:cut]] += 1
    assert wanted == Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited"]) for r in found)
    prints = defaultdict(set)
    for r in found:
        text = dict((a, b) for a, b in rows)[r["doc_id"] if r["doc_id"] is not None else -1]
        prints[text].add(r["fingerprint"])
        a, b = _plain(text), _plain(r["edited"])
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - true) < 0.2
    assert all(len(p) == 1 for p in prints.values())


def _plain(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_decontamination(spark):
    random.seed(9)
    words = [f"v{i}" for i in range(5000)]
    items = [" ".join(random.sample(words, 30)) for _ in range(4)] + ["short item of six words here", "too short"]
    clean = [" ".join(random.sample(words, 200)) for _ in range(20)]
    changed = items[1].split()
    changed[5] = changed[15] = changed[25] = "zz"
    texts = clean + [clean[0] + " " + items[0].upper() + "! " + clean[1], clean[2] + " " + " ".join(changed), "a " + items[4] + " b", "too short", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, bench).collect()}
    assert found == {(20, 0), (21, 1), (22, 4)}
    assert decontamination.clean(docs, bench).count() == len(texts) - 3
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


def test_language(docs, spark):
    rows = [(i, "der die das und nicht " * 4 if i % 2 else "the and that with from " * 4, "de" if i % 2 else "en") for i in range(60)]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learnt(known)
    asked = spark.createDataFrame([(1, "nicht und"), (2, "with THE"), (3, None), (4, "12 !!"), (5, ""), (6, "thatwith")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, model, ["doc_id"]).collect()}
    assert found == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", 6: "en"}
    kept = language.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (0, 1, 2)").count() == 0


def test_language_of_more_unseen_words_than_the_cache_holds():
    def words(letters, n):
        return ["".join(w) for w in islice(product(letters, repeat=5), n)]

    early, late = words("abcdefghijklm", 70_000), words("nopqrstuvwxyz", 50_000)
    text = " ".join(early[:50_000] + late + early[50_000:])
    assert len(text) < language._CHUNK
    at = {(1, c): i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    logs = np.array([[0, -1e-5]] * 13 + [[-1e-5, 0]] * 13, np.float32)
    scores = language._Scores(at, logs)
    for _ in range(2):
        lang, score = language._judge(text, ["one", "two"], scores)
        assert lang == "one" and abs(score - 1 / (1 + np.exp(-0.2))) < 1e-3
        language._judge(" ".join(words("acegikmoqsuwy", 45_000)), ["one", "two"], scores)


def test_quality(spark):
    random.seed(4)
    good = [" ".join(random.choice(["calm", "river", "stone", "walks"]) for _ in range(50)) + "." for _ in range(150)]
    bad = [" ".join(random.choice(["calm", "river"]) + "%%%" for _ in range(50)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(good + bad), (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id bigint, quality int")
    found = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(found) == 302 and all(0 <= r["score"] <= 1 for r in found.values())
    assert np.mean([found[i]["predicted"] == int(i < 150) for i in range(300)]) > 0.97


def test_sum_of_squares_identity():
    random_ = np.random.default_rng(0)
    model = quality.Machine(0.3, random_.normal(size=quality.FEATURES), random_.normal(size=(quality.FEATURES, 3)))
    columns, x = np.array([5, 9, 40]), np.array([0.5, 2.0, -1.0])
    pairs = sum(model.factors[columns[i]] @ model.factors[columns[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    margin, _ = model.margins(1, np.zeros(3, int), columns, x)
    assert np.isclose(margin[0], 0.3 + model.weights[columns] @ x + pairs)


PAGE = """<html><head><title>T</title></head><body><nav>menu</nav><div class="cookie-notice">cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
 three.<br><p>Four&nbsp;five<div class='ad'>buy</div><section id=comments><p>nice</p></section><form>x</form>
<script>var t="</p>";</script><p>last &lt;b&gt;</article><aside>side</aside><footer>foot</footer>"""


def test_html_blocks():
    assert html.blocks(PAGE) == (["Head & line", "One two three.", "Four five", "last <b>"], [], True)
    assert html.blocks("") == ([], [], False)
    assert html.blocks("plain <b>te")[1] == ["plain te"]


def test_html_suffix_array(spark):
    rng = random.Random(1)
    for _ in range(20):
        tokens = np.array([rng.randrange(3) for _ in range(40)])
        wanted = sorted(range(40), key=lambda i: tokens[i:].tolist())
        assert html.suffix_array(tokens).tolist() == wanted
    shared = "all rights reserved by the owner of this site"
    rows = [(i, "http://h.org/a", f"<div>own text number {i}</div><div>{shared}</div>") for i in range(4)] + [(9, None, None), (10, "http://h.org/b", PAGE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.main_text(pages, ["page_id", "url"]).collect()}
    assert all(found[i] == f"own text number {i}" for i in range(4))
    assert found[9] == "" and found[10].startswith("Head & line\n")


def test_html_runs_of_a_host_in_several_chunks(spark):
    shared, rare = "all rights reserved by the owner of this site", "only two of the pages say this much"
    extra = {i: shared for i in range(0, 1200, 200)} | {7: rare, 900: rare}
    rows = [(i, f"http://big.org/{i}", f"<div>own words {i}</div><div>{extra.get(i, '')}</div>") for i in range(1200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in html.main_text(pages, ["page_id"]).collect()}
    assert found == {i: f"own words {i}" + (f"\n{rare}" if i in (7, 900) else "") for i in range(1200)}


def test_html_copies_are_one_page(spark):
    copied, shared = "<div>one two three four five six seven</div>", "all rights reserved by the owner of this site"
    rows = [(i, f"http://c.org/{i}", copied) for i in range(3)] + [(3, "http://c.org/3", copied)] * 3
    rows += [(i, f"http://d.org/{i}", f"<article>text {i}</article><div>{shared}</div>") for i in (4, 5)]
    rows += [(6, "http://d.org/6", f"<div>own</div><div>{shared}</div>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    found = Counter((r["page_id"], r["text"]) for r in html.main_text(pages, ["page_id"]).collect())
    wanted = {(i, "one two three four five six seven"): 1 for i in range(3)} | {(3, "one two three four five six seven"): 3}
    assert found == wanted | {(4, "text 4"): 1, (5, "text 5"): 1, (6, "own"): 1}


def test_html_run_counts_equal_brute_force():
    rng = random.Random(5)
    streams = [[" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(4))] for _ in range(30)]
    plain = Counter(g for s in streams for g in {tuple(w[i : i + 6]) for w in [" ".join(s).split()] for i in range(len(w) - 5)})
    words = html.words_of(streams)
    runs, counts = html.run_counts(words)
    assert sorted(counts) == sorted(plain.values()) and len(set(runs)) == len(plain)
    covered = html.covered_by(words, runs[counts >= 3])
    for stream, hit in zip(streams, covered):
        w = " ".join(stream).split()
        wanted = {j for i in range(len(w) - 5) if plain[tuple(w[i : i + 6])] >= 3 for j in range(i, i + 6)}
        assert set(np.flatnonzero(hit)) == wanted and len(hit) == len(w)


def test_empty_tables(spark, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    assert substrings.removed(empty, ["doc_id"]).count() == 0
    assert packing.pack(empty).count() == 0
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert language.identify(empty, language.learnt(empty), ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.main_text(pages, ["page_id"]).count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "packing"]
    total = out.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    assert 0 < total[1] < 200
    assert set(queries.ORACLES) <= set(queries.QUERIES)
