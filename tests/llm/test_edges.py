"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import contamination, html_text, jaccard, language, mixing, personal, quality_model, quality_rules, secrets, url_templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ["The river runs slowly to the north and the town lies on its bank. ", "Und der alte Fluss zieht langsam an der Stadt vorbei, die dort liegt. "]


def rows():
    out = [(i, (PROSE[i % 2] + f"Only text {i} has word{i} and term{i * 7}. ") * (1 + i % 3), ["en", "de"][i % 2], ["a", "b", None][i % 3], None) for i in range(24)]
    return [*out, (None, None, None, None, None), (100, None, "en", "a", 0), (101, "", None, None, None), (102, " \n\t ", "de", "b", 3), (103, "123 456", None, "a", None), (103, "123 456", None, "a", None), (104, PROSE[0] * 4000, "en", "a", None), (None, "A text without an id, but with words in it.", "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """Extra columns whose names the operators use themselves."""
    names = ("size", "taken", "target", "score", "spans", "set", "shard", "token", "predicted", "lang_pred", "key", "__words", "stop")
    return docs.withColumns({n: F.lit("x") for n in names})


def test_mix(spark, docs, none, odd):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    for source in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 64
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(odd).count() == len(rows())


def test_mix_of_small_sources(spark):
    """Taken words are near their target for sources of a few words too; null and repeated ids are dealt by text."""
    rng = random.Random(3)
    for sizes in ((100, 100, 100), (40, 40, 40), (20, 20, 20), (5, 5, 5), (1, 2, 3), (7, 200, 3000), (1, 1, 20_000)):
        docs = []
        for k, size in enumerate(sizes):
            while size:
                n = min(size, rng.randrange(1, 30))
                docs.append((rng.choice([None, 1, len(docs)]), "abc"[k], f"t{len(docs)} " * n))
                size -= n
        df = spark.createDataFrame(docs, "doc_id long, source string, text string")
        got = mixing.mix_sources(df, keep=("text", "size")).collect()
        assert len(got) == len(docs) and len(got[0]) == 6
        for source in "abc":
            own = [r for r in got if docs[[t for _, _, t in docs].index(r["text"])][1] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(3), keep=("text", "size")).collect()))


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").split()]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(sets)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    for _ in sets:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return [len(s) for s in sets], comp


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, words, percent):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(30):  # a chain: each text differs in a word from the one before
        base = [*base[:i], f"x{i}", *base[i + 1 :]] if i % 3 else base
        texts.append(" ".join(base))
    texts += [texts[0], texts[0].upper(), "short one", "short one", "", None, "a b c", "a b c d", *(" ".join(f"v{(i * j) % 97}" for i in range(40)) for j in range(5))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size, comp = brute(texts, words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df, words, percent, chunk=8).collect()}
    assert got == {i: (size[i], comp[i]) for i in range(len(texts))}
    kept = {r["doc_id"] for r in jaccard.drop_near_copies(df, words, percent).collect()}
    assert kept == set(comp)


def test_jaccard_ids(spark):
    """Null ids, and one id on other texts, are linked by each row's own text."""
    a = " ".join(f"w{i}" for i in range(60))
    near = a + " more"
    b, c = ("b " + " ".join(f"{x}{i}" for i in range(50)) for x in "uv")
    texts = [(1, a), (1, c), (2, near), (None, near + " words"), (None, c), (3, c + " x"), (None, None), (7, c), (7, c), (8, b), (8, a), (None, b + " x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_copies(df, 3, 90).collect())
    assert got == sorted([("1", 58, "1"), ("1", 49, "1"), ("2", 59, "1"), ("None", 60, "1"), ("None", 49, "1"), ("3", 50, "1"), ("None", 0, "None"), ("7", 49, "1"), ("7", 49, "1"), ("8", 49, "8"), ("8", 58, "1"), ("None", 50, "8")])
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard.drop_near_copies(df, 3, 90).collect())
    assert kept == sorted([("1", a), ("1", c), ("8", b), ("None", "")])


def test_jaccard_where_many_pairs_fail(spark, chunk=6):
    """Blocks full of pairs near the threshold on either side, and of large sets whose bitmaps say little."""
    rng = random.Random(chunk)
    texts = []
    for size, copies, edits in ((40, 40, 2), (400, 25, 25), (3000, 12, 110)):
        base = [f"{size}w{rng.randrange(size * 5)}" for _ in range(size)]
        for _ in range(copies):
            own = base[:]
            for i in rng.sample(range(size // 4, size), rng.randrange(edits + 1)):
                own[i] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    size, comp = brute(texts, 3, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df, 3, 80, chunk=chunk).collect()}
    assert got == {i: (size[i], comp[i]) for i in range(len(texts))}
    assert 3 < len(set(comp)) < len(texts) - 3


def joined_by_set(spark):
    """Rows that inner joins by set have made so far, as Spark counts them."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for e in (runs.apply(i).executionId() for i in range(runs.size())):
        counts, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[set#\d+\], \[set#\d+\], Inner", node.desc()):
                rows = [counts.get(node.metrics().apply(i).accumulatorId()) for i in range(node.metrics().size()) if node.metrics().apply(i).name() == "number of output rows"]
                total += sum(int(x.get().replace(",", "")) for x in rows if x.isDefined())
    return total


def test_jaccard_reads_a_row_of_a_block_once(spark, monkeypatch):
    """A large group of near copies, cut into chunks: its rows meet their sets once a round, not once for each way to deal them."""
    rng, texts = random.Random(3), []
    base = [f"w{i}" for i in range(60)]
    for _ in range(90):
        own = base[:]
        for i in rng.sample(range(15, 60), rng.randrange(4)):
            own[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    kept, table, before = [], jaccard.Scratch.table, joined_by_set(spark)

    def counted(steps, name, df):
        out = table(steps, name, df)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard.Scratch, "table", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size, comp = brute(texts, 3, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df, 3, 80, chunk=8).collect()} == {i: (size[i], comp[i]) for i in range(len(texts))}
    rows, sets = sum(n for name, n in kept if name.startswith(("blocks", "open"))), sum(n for name, n in kept if name.startswith(("held", "known")))
    assert sum(n for name, n in kept if name.startswith("open")) > len(texts)
    assert 0 < joined_by_set(spark) - before <= rows + 2 * sets + 2 * len(texts)


def test_open_chunks_let_all_others_meet(spark):
    """Of each open block any two sets of different components meet in one chunk, on its two sides or in a chunk of its own."""
    rng = random.Random(4)
    rows = [(t, n, i, (0 if rng.random() < 0.6 else rng.randrange(1, 9))) for t, n in ((1, 70), (2, 9), (3, 30)) for i in range(n)]
    blocks = spark.createDataFrame(rows, "token long, size long, set long, comp long")
    chunks = {}
    for r in jaccard._open_chunks(blocks, jaccard._main_components(blocks, 10), 10).collect():
        chunks.setdefault((r["token"], r["c0"], r["c1"]), []).append((r["set"], r["side"]))
    met = [(k[0], min(x, y), max(x, y)) for k, v in chunks.items() for i, (x, p) in enumerate(v) for y, q in v[:i] if p == 2 or p != q]
    pairs = {(t, i, j) for t, _, i, a in rows for u, _, j, b in rows if t == u and i < j and a != b}
    assert pairs <= set(met) and len(met) == len(set(met))


def test_components_in_tables(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 9)] + [(200, 201), (201, 200), (7, 7)]
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in chain if max(a, b) < 256], "a binary, b binary")
    for limit in (1000, 3):
        got = {r["set"][0]: r["comp"][0] for r in jaccard.components(links, in_one_task=limit).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(9)}, 200: 200, 201: 200}


def test_jaccard_edges(docs, none, odd):
    got = jaccard.near_copies(docs).collect()
    assert len(got) == len(rows())
    assert jaccard.near_copies(none).count() == 0
    kept = jaccard.drop_near_copies(odd)
    assert kept.where("doc_id = 103").count() == 1 and kept.where("doc_id is null").count() == 2 and set(kept.columns) == set(odd.columns)


def test_quality_rules(docs, none, odd):
    got = {r["doc_id"]: r for r in quality_rules.clean_documents(odd).where("doc_id is not null").collect()}
    assert got[101]["base_failed"] and not got[100]["kept"] and got[0]["kept"] and got[104]["base_failed"]
    assert quality_rules.clean_documents(none).count() == 0


def test_line_rules(spark):
    good = "Ten plain words stand here, in a line that ends well."
    lines = [good, "Home | About | Contact", "All rights reserved.", "BUY!! NOW!! CHEAP!!", "a### b$$$ c%%%", "Log in"]
    r = quality_rules.clean_documents(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert r["clean_text"] == good and r["n_lost_lines"] == 5


def test_classifiers(spark, docs, none, odd):
    model = language.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model, ["doc_id"]).where("doc_id is not null").collect()}
    assert got[0] == "en" and got[1] == "de" and got[100] == got[101] == got[103] == "und"
    assert language.identify(odd, model, odd.columns).count() == len(rows())
    assert language.identify(none, language.fit(none), ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)] + [(0, 1, None), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = quality_model.score_quality(odd, quality_model.fit(docs, labels), ["doc_id", "size"]).collect()
    assert len(scored) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    assert quality_model.score_quality(none, quality_model.fit(none, labels.limit(0)), ["doc_id"]).count() == 0


def test_columns_of_the_caller_survive(docs, odd):
    """Names that the operators use inside, or for what they drop again, stay the caller's."""
    own = odd.withColumns({n: F.lit("x") for n in ("about_words", "about_lines", "raw_text", "text_in", "salt", "gone_id", "quota", "name")})
    extra = [c for c in own.columns if c not in docs.columns]
    for kept in (quality_rules.clean_documents(own), personal.redact(own), language.keep_identified(own), jaccard.drop_near_copies(own.limit(9)), mixing.mix_sources(own, keep=[c for c in own.columns if c not in ("size", "target", "taken")])):
        still = [c for c in extra if c not in ("size", "target", "taken")] if "taken" in kept.columns and kept.columns.count("size") == 1 and "source_size" in kept.columns else extra
        assert kept.columns.count("size") == 1
        assert kept.select(*still).distinct().collect() == [tuple("x" for _ in still)]


def test_texts_of_several_languages_are_kept(spark):
    words = {"en": "the river runs north and ", "de": "und der alte Fluß zieht ", "ru": "река течёт на север и ", "el": "το ποτάμι κυλά αργά και "}
    rows = [(4 * i + k, words[x] * (20 + i), x) for i in range(12) for k, x in enumerate(words)] + [(100, "".join(w * 12 for w in words.values()) * 2, None), (101, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = {r["doc_id"]: r["score"] for r in language.identify(docs, language.fit(docs), ["doc_id"]).collect()}
    assert scores[100] < 0.5
    assert {r["doc_id"] for r in language.keep_identified(docs).collect()} == set(scores) - {101}


def test_texts_of_no_language_go(spark):
    """The network decides; texts of other languages, short and mixed ones stay."""
    rng = random.Random(8)
    run = lambda letters, low, high: " ".join("".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(1200 // low))
    nothing = [run("0123456789abcdef", 32, 64), run("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 60, 76), run("abcdefghijklmnopqrstuvwxyz", 3, 12), run("asdfghjkl;", 4, 12)]
    other = ["Joki virtaa hitaasti pohjoiseen ja kaupunki sijaitsee sen rannalla, missä vanhat talot seisovat vierekkäin. ", "Rzeka płynie powoli na północ, a miasto leży na jej brzegu, gdzie stare domy stoją obok siebie. ", "Το ποτάμι κυλά αργά προς τα βόρεια και η πόλη βρίσκεται στην όχθη του. ", "河水缓缓向北流去，城镇坐落在河岸上，那里的老房子并排矗立，人们在傍晚散步。"]
    kept = [*(x * 8 for x in other), nothing[0] + " " + PROSE[0] * 12, "qxz kjw", PROSE[1]]
    rows = [(i, PROSE[i % 2] * (4 + i), ("en", "de")[i % 2]) for i in range(30)] + [(100 + i, t, None) for i, t in enumerate(kept)] + [(200 + i, t, None) for i, t in enumerate(nothing)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.keep_identified(docs).collect()} == {i for i, _, _ in rows if i < 200}
    assert language.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows)  # nothing is learned without labels


def test_scans(docs, none, odd):
    for scan in (secrets.scan_secrets, personal.scan_personal):
        assert scan(odd, odd.columns).count() == len(rows())
        assert scan(none, ["doc_id"]).count() == 0
        assert scan(docs, ["doc_id"]).where("spans is null").count() == 0
    masked = personal.redact(odd)
    assert masked.count() == len(rows()) and masked.where("doc_id = 100").first()["text"] is None and personal.redact(none).count() == 0


def test_contamination(spark, docs, none, odd):
    items = spark.createDataFrame([(1, PROSE[0] + "Only text 4 has word4 and term28."), (1, PROSE[0] + "Only text 4 has word4 and term28."), (2, None), (None, ""), (3, "never seen words stand in here and are not found")], "item_id long, text string")
    found = contamination.find_contaminated(odd, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(4, 1)}
    several = contamination.find_contaminated(docs, items, index_bytes=64)
    assert {(r["doc_id"], r["item_id"]) for r in several.collect()} == {(4, 1)}
    assert contamination.find_contaminated(none, items).count() == contamination.find_contaminated(docs, items.limit(0)).count() == 0
    assert contamination.drop_contaminated(docs, items).count() == len(rows()) - 1


def test_contamination_in_parts(spark):
    texts = [" ".join(f"w{(i * i + 7 * j) % (20 + 9 * (i % 5))}" for j in range(12 + i)) for i in range(30)]
    items = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (40, ""), (41, None)], "item_id long, text string")
    copies = [(i, "before it " + " ".join([*t.split()[:3], "edited", *t.split()[4:]]) + " and after") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    whole = sorted(map(tuple, contamination.find_contaminated(docs, items).select("doc_id", "item_id", "score").collect()))
    assert {(i, i) for i in range(30)} <= {r[:2] for r in whole} and min(r[2] for r in whole) < 0.99
    assert sorted(map(tuple, contamination.find_contaminated(docs, items, index_bytes=1000).select("doc_id", "item_id", "score").collect())) == whole


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://x/1", None, "x"), (1, None, "", "x"), (2, "u", "<article><p>Some words stand here, and they are the main text of it.</article>" * 300, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages, ["page_id", "url"]).orderBy("page_id").collect()
    assert [len(r["text"]) > 0 for r in got] == [False, False, True]
    assert html_text.extract_text(pages.limit(0), pages.columns).count() == 0


def plain_templates(urls, children=8, thin=20.0):
    """The template of each (host, segments) by a plain walk of whole paths, however deep."""
    out = {}

    def walk(template, below, level):
        for segments, original in [x for x in below if len(x[0]) <= level]:
            out[original] = template
        going = [x for x in below if len(x[0]) > level]
        steps = {x[0][level] for x in going}
        wide = len(steps) >= children and len(going) < thin * len(steps)
        for name in ["*"] if wide else sorted(steps):
            walk(f"{template}/{name}", [x for x in going if wide or x[0][level] == name], level + 1)

    for host in sorted({h for h, _ in urls}):
        walk(host, [(segments, (h, segments)) for h, segments in urls if h == host], 0)
    return out


def test_url_templates_of_any_depth(spark):
    rng = np.random.default_rng(5)
    deep = ["/".join(["a"] * 9 + [f"{a}{b}x" for a, b in zip("pqrstuvwxyz", rng.permutation(list("klmnopqrstu")), strict=True)][: k % 4 + 1]) for k in range(60)]
    mixed = ["/".join(f"{'abcdefghijkl'[rng.integers(0, 12 if d == 2 else 2)]}y" for d in range(rng.integers(1, 6))) for _ in range(300)]
    urls = [(i, f"http://{h}.example.org/{path}") for i, (h, path) in enumerate([("deep", p) for p in deep] + [("mixed", p) for p in mixed] + [("deep", "/".join("z" * 400)), ("empty", "")])]
    got = url_templates.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int"), rules=()).collect()
    parsed = {r["page_id"]: (r["host"], tuple(r["path"][1:].split("/"))) for r in got}
    # pages of a path count each, so the plain walk takes every page
    below = [(parsed[i][0], parsed[i][1]) for i, _ in urls]
    want = plain_templates(below)
    assert {r["page_id"]: r["template"] for r in got} == {i: want[parsed[i]] for i, _ in urls}
    assert any("*" in t and t.count("/") > 9 for t in want.values())  # a wildcard beyond any fixed depth


def plain_branches(leaves, alike=1.96):
    """The branch of each leaf, by steps, from counts of labels and bad ones: branch by branch, deepest first."""
    out = {steps: ("leaf", steps) for steps in leaves}
    depth = {steps: len(steps) - 1 for steps in leaves}
    for level in range(max(depth.values()), 0, -1):
        here = [s for s in leaves if depth[s] == level]
        counts, pools = {}, {}
        for s in here:
            for into, key in ((counts, (out[s], s[:level])), (pools, s[:level])):
                n, b = into.get(key, (0, 0))
                into[key] = n + leaves[s][0], b + leaves[s][1]
        for s in here:
            (n, b), (all_n, all_b) = counts[out[s], s[:level]], pools[s[:level]]
            rest = all_n - n
            if n and rest:
                p = all_b / all_n
                if abs(b / n - (all_b - b) / rest) - (1 / n + 1 / rest) / 2 > alike * max((p * (1 - p) * (1 / n + 1 / rest)) ** 0.5, 1e-9):
                    depth[s] = -1  # stands alone
                    continue
            depth[s] = level - 1
        for s in here:
            if depth[s] >= 0:
                out[s] = ("node", s[:level])
    return out


def test_url_branches_merge_up_to_the_host(spark):
    rng = np.random.default_rng(3)
    urls, bad = [], []
    for k in range(900):
        top, inner, last = "news shop help".split()[k % 3], f"{'abcd'[rng.integers(4)]}x", f"{'pqrstu'[rng.integers(6)]}y"
        urls.append((k, f"http://{'one' if k % 2 else 'two'}.example.org/{top}/{inner}/{last}" + "/deep" * int(rng.integers(0, 3))))
        if rng.random() < 0.6:
            bad.append((k, int(rng.random() < (0.95 if (top, inner) == ("shop", "bx") else 0.05))))
    got = url_templates.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), rules=()).collect()
    # nodes of too few paths end the walk: their rest is one step
    keys, known = {r["page_id"]: r["template"] for r in got}, dict(bad)
    distinct = {t: set() for t in keys.values()}
    parts = {t: tuple(t.split("/")) for t in distinct}
    steps = {}
    for t, p in parts.items():
        n = 1
        while n < len(p) and len({q for q in parts.values() if q[:n] == p[:n]}) >= 8:
            n += 1
        steps[t] = (*p[: n - 1], "/".join(p[n - 1 :])) if n <= len(p) and len({q for q in parts.values() if q[: n - 1] == p[: n - 1]}) < 8 else (*p[:n],) if n >= len(p) else (*p[:n], "/".join(p[n:]))
    leaves = {}
    for k, t in keys.items():
        n, b = leaves.get(steps[t], (0, 0))
        leaves[steps[t]] = n + (k in known), b + known.get(k, 0)
    branch = plain_branches(leaves)
    rate, sums = sum(known.values()) / len(known), {}
    for s, (n, b) in leaves.items():
        a, c = sums.get(branch[s], (0, 0))
        sums[branch[s]] = a + n, c + b
    purity = {t: (sums[branch[s]][1] + 10 * rate) / (sums[branch[s]][0] + 10) for t, s in steps.items()}
    assert all(abs(r["purity"] - purity[r["template"]]) < 2e-6 and r["verdict"] == ("block" if purity[r["template"]] >= 0.6 else "allow") for r in got)
    wrong = [r for r in got if (r["verdict"] == "block") != ("/shop/bx" in r["path"])]
    assert len(wrong) <= 0.1 * sum("/shop/bx" in r["path"] for r in got)
    assert len({branch[s] for s in steps.values()}) < len(steps) / 3  # most have merged


def test_urls(spark):
    urls = [(i, f"https://Good.example.org/en/{i}") for i in range(40)] + [(100 + i, f"https://spam.example.edu/buy/{i}.html?x=1") for i in range(40)] + [(200 + i, f"http://slugs.example.edu/post/name-{chr(97 + i)}x") for i in range(26)]
    urls += [(900, None), (901, "no scheme/x"), (902, "http://example.com/en/7#a"), (903, "http://WWW.example.com/en/8"), (904, "http://badexample.com/en/"), (905, "http://notcom/en/x"), (906, "ftp://a.net/de/8"), (907, "ftp://example.net/de/81"), (907, "ftp://example.net/de/81"), (None, "http://x.org/es/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("x"))
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(30)] + [(100, 0), (None, 1)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_templates.judge_urls(pages, labels).where("page_id is not null").collect()}
    assert (got[900]["host"], got[900]["path"], got[901]["host"], got[902]["rule"], got[902]["verdict"]) == ("", "", "", "example.com/en/7", "allow")
    assert (got[903]["rule"], got[904]["rule"], got[905]["rule"], got[906]["verdict"], got[907]["verdict"]) == ("com/en/", "com/en/", None, "allow", "block")
    assert got[3]["verdict"] == "allow" and {got[100 + i]["verdict"] for i in range(40)} == {"block"} and got[3]["host"] == "good.example.org"
    assert {got[200 + i]["template"] for i in range(26)} == {"slugs.example.edu/post/*"}
    assert url_templates.judge_urls(pages.limit(0), labels).count() == 0
    assert {r["verdict"] for r in url_templates.judge_urls(pages.where("page_id < 200"), labels.limit(0)).collect()} == {"allow"}


def test_stages(spark, docs, none):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert set(out.columns) >= set(docs.columns) and 0 < out.count() <= len(rows()), name
        assert stage(spark, none, folder).count() == 0, name


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    whole = corpus_pipeline.run(spark, folder).toPandas()
    text = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id")["text"]
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()["text"]
    norm = lambda t: " ".join(t.lower().split())
    held = {i for i, t in text.items() if any(norm(b) in norm(t) for b in bench)}
    assert not held & set(whole["doc_id"]) and not whole["doc_id"].duplicated().any()
    assert not any(personal.base_spans(t) for t in whole["text"]) and (whole["taken"] > 0).all()
    _, comp = brute(list(text), 5, 80)
    ids = list(text.index)
    assert set(whole["doc_id"]) <= {ids[c] for c in comp}
