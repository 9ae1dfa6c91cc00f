import random

import numpy as np
import pytest

from stilus.llm import abuse, canonical, chunking, frequency, language, leakage, mixing, overlap, pii
from stilus.llm.lookalike import visible, words_text


# -- 1 ---------------------------------------------------------------------------------------
def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_words_against_table():
    g = random.Random(1)
    for _ in range(200):
        a, b = ([g.choice("abcde") for _ in range(g.randrange(1, 14))] for _ in range(2))
        assert overlap.common_words(a, b) == _lcs(a, b)


def test_cross_split_pairs_against_brute_force(spark):
    g = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(120):
        w = [g.choice(vocabulary) for _ in range(g.randrange(10, 80))]
        rows.append((3 * i, " ".join(w), "train"))
        if i % 3 == 0:
            v = list(w)
            for _ in range(max(1, len(v) // 12)):
                v[g.randrange(len(v))] = g.choice(vocabulary)
            rows.append((3 * i + 1, ", ".join(v).upper(), "AA_test"))
        if i % 5 == 0:
            rows.append((3 * i + 2, " ".join(w[: len(w) // 2]), "AA_val"))
    rows += [(900, None, "train"), (901, "", "AA_val"), (902, "too short", None), (903, rows[0][1], "AA_val"), (904, rows[0][1], "train")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "row_id long, text string, split string, cls int")
    from pyspark.sql import functions as F

    members, links = overlap.cross_split_classes(df, "row_id", "text", F.col("split") == "train")
    got = {tuple(r) for r in overlap.linked_ids(members, links, "a", "b").collect()}
    w = {i: words_text(t or "").split() for i, t, _ in rows}
    want = {(min(i, j), max(i, j)) for i, _, s in rows for j, _, z in rows if s == "train" and z != "train" and min(len(w[i]), len(w[j])) >= 10 and _lcs(w[i], w[j]) >= 0.8 * max(len(w[i]), len(w[j]))}
    assert got == want and len(want) > 30
    members, links = overlap.cross_split_classes(df.limit(0), "row_id", "text", F.col("split") == "train")
    assert links.count() == 0


def _pairs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "row_id long, text string, split string").repartition(4)
    members, links = overlap.cross_split_classes(df, "row_id", "text", F.col("split") == "train")
    return {tuple(r) for r in overlap.linked_ids(members, links, "a", "b").collect()}


def test_near_copy_of_a_hot_text(spark):
    g = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(g.choice(vocabulary) for _ in range(100)), "train" if i % 2 else "AA_val") for i in range(2000)]
    hot = [g.choice(vocabulary) for _ in range(100)]
    copies = range(2000, 2600)
    rows += [(i, " ".join(hot), "train") for i in copies]
    changed, shorter = [*hot[:50], "word7" if hot[50] != "word7" else "word8", *hot[51:]], hot[:30] + hot[31:]
    rows += [(3000, " ".join(changed), "AA_test"), (3001, " ".join(shorter), "AA_test")]
    assert _pairs(spark, rows) == {(i, j) for i in copies for j in (3000, 3001)}


def test_hot_lists_are_cut_on_both_sides(spark, monkeypatch):
    """No part of a hot list holds all of either side, and every pair meets all the same."""
    own, left = np.arange(2000), np.arange(2000) % 2 == 0
    for groups in (50, 7):
        entry, group = overlap.dealt(own, np.zeros(2000, np.uint64), own, left, np.tile([[4], [5]], (1, 2000)), groups)
        cells = [{int(i) for i in entry[group == k]} for k in range(groups)]
        assert sum(map(len, cells)) == len(entry)
        met = np.zeros((2000, 2000), bool)
        for c in cells:
            met[np.ix_([i for i in c if left[i]], [i for i in c if not left[i]])] = True
        assert met[np.ix_(left, ~left)].all()
    entry, group = overlap.dealt(own, np.zeros(2000, np.uint64), own, left, np.tile([[4], [5]], (1, 2000)), 50)
    assert np.bincount(group).max() <= 2 * (1000 / 4 + 1000 / 5)
    monkeypatch.setattr(overlap, "HOT", 16)
    monkeypatch.setattr(overlap, "GROUP_BYTES", 20_000)
    g = random.Random(8)
    base = [g.choice([f"w{i}" for i in range(60)]) for _ in range(25)]
    rows = [(i, " ".join(w if g.random() > 0.1 else g.choice(base) for w in base), "train" if i % 2 else "AA_val") for i in range(300)]
    words = {i: t.split() for i, t, _ in rows}
    want = {(min(i, j), max(i, j)) for i in words for j in words if i % 2 and not j % 2 and _lcs(words[i], words[j]) >= 20}
    assert _pairs(spark, rows) == want and len(want) > 1000


def test_a_group_of_lists_fits_a_task(spark):
    """A group of the lists of about 6 GB of texts, each entry of another text, as with many groups."""
    import tracemalloc

    runs, g = 1_900_000_000, np.random.default_rng(4)
    n = runs * 6 // 10 // overlap._group_count(spark, runs)
    p = overlap.Postings(np.arange(n), g.integers(15, 40, n).astype(np.int32), g.random(n) < 0.7, g.integers(0, 1 << 62, (n, overlap.SKETCH // 64), np.uint64), g.integers(0, n // 3, n).astype(np.uint32), np.arange(n), g.integers(0, 30, n).astype(np.int32))
    blobs = [p.to_bytes()]
    del p
    tracemalloc.start()
    overlap.meetings(overlap.Postings.of(blobs).one_per_class())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + 2 * len(blobs[0]) < 450e6  # two tasks of an executor have 1,200 MB beside its heap


@pytest.mark.parametrize("every", [5, 6, 7])
def test_evenly_spread_edits(spark, every):
    g = random.Random(every)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [[g.choice(vocabulary) for _ in range(g.choice([45, 60, 100, 210]))] for _ in range(40)]
    rows = [(2 * i, " ".join(w), "train") for i, w in enumerate(texts)]
    rows += [(2 * i + 1, " ".join(g.choice(vocabulary) if k % every == every - 1 else x for k, x in enumerate(w)), "AA_test") for i, w in enumerate(texts)]
    assert _pairs(spark, rows) == {(2 * i, 2 * i + 1) for i in range(len(texts))}


def test_lists_hold_a_paired_run_of_every_pair():
    g = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    place = np.random.default_rng(2).integers(1, 255, overlap.SLOTS).astype(np.uint8)
    codes = overlap._Codes()
    for _ in range(400):
        a = [g.choice(vocabulary) for _ in range(g.randrange(10, 70))]
        out, into = set(g.sample(range(len(a)), len(a) // 5)), set(g.sample(range(len(a)), len(a) // 5))
        b = [y for i, x in enumerate(a) for y in ([] if i in out else [x]) + ([g.choice(vocabulary)] if i in into else [])]
        b = b[: 5 * len(a) // 4]
        if len(b) < overlap.MIN_WORDS or not overlap.mostly_same(" ".join(a), " ".join(b)):
            continue
        runs = overlap.Runs([" ".join(a), " ".join(b)], codes)
        pick = runs.indexed(place)
        sketch, text = runs.sketches(), runs.row[pick]
        p = overlap.Postings(np.array([5, 9]), runs.n.astype(np.int32), np.array([True, False]), sketch, runs.run[pick].astype(np.uint32), text, runs.at[pick].astype(np.int32))
        x, y = overlap.meetings(overlap.Postings.of([p.to_bytes()]))
        assert list(x) == [0] and list(y) == [1]


def test_variants_of_a_template(spark):
    g = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    template = [g.choice(vocabulary) for _ in range(40)]
    rows, words = [], {}
    for i in range(200):
        w = list(template)
        for k in g.sample(range(40), 3):
            w[k] = g.choice(vocabulary)
        words[i] = w
        rows.append((i, " ".join(w), "train" if i % 2 else "AA_val"))
    want = {(min(i, j), max(i, j)) for i in range(1, 200, 2) for j in range(0, 200, 2) if _lcs(words[i], words[j]) >= 32}
    assert _pairs(spark, rows) == want and len(want) > 9000


def test_overlap_with_empty_partitions_and_one_side(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "train"), (2, text.upper(), "AA_val"), (3, text + " twelve", "AA_test")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "row_id long, text string, split string").repartition(8)
    members, links = overlap.cross_split_classes(df, "row_id", "text", F.col("split") == "train")
    assert {tuple(r) for r in overlap.linked_ids(members, links, "a", "b").collect()} == {(1, 2), (1, 3)}
    members, links = overlap.cross_split_classes(df.where("split = 'train'"), "row_id", "text", F.col("split") == "train")
    assert links.count() == 0


def test_hot_classes_are_expanded_in_sets(spark):
    members = spark.range(5000).selectExpr("id", "id % 2 = 0 AS is_left", "7L AS class")
    links = spark.createDataFrame([(7, 7)], "left long, right long")
    assert overlap.linked_ids(members, links, "a", "b").count() == 2500 * 2500


@pytest.mark.parametrize("copies, at", [(300, (20, 50, 80)), (400, (20, 50, 80)), (500, (50,))])
def test_equal_lengths_whatever_the_rarity(spark, copies, at):
    g = random.Random(copies)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(g.choice(vocabulary) for _ in range(100)), "train" if i % 2 else "AA_val") for i in range(2000)]
    hot = [g.choice(vocabulary) for _ in range(100)]
    rows += [(2000 + i, " ".join(hot), "train") for i in range(copies)]
    edited = [g.choice(vocabulary) if k in at else w for k, w in enumerate(hot)]
    rows.append((3000, " ".join(edited), "AA_test"))
    assert _pairs(spark, rows) == {(2000 + i, 3000) for i in range(copies)}


# -- 3 ---------------------------------------------------------------------------------------
def test_same_look(spark):
    rows = [(1, "café a"), (2, "café а"), (3, "ca​fé a"), (4, "cafe a"), (5, "CAFÉ a"), (6, "m2"), (7, "m²"), (8, None), (9, ""), (10, "​"), (2, "café а"), (11, "ﬁｎe"), (12, "fine"), (13, "fi\nne")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "post_id long, text string, block string")
    got = sorted(map(tuple, canonical.same_look_pairs(df, "post_id", "text", "a", "b").collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (9, 10), (11, 12)]
    form = {r[0]: r[2] for r in canonical.canonicalize(df, "post_id", "text").collect()}
    assert form[1] == form[2] == form[3] == "café a" and form[4] == "cafe a" and form[8] is None and form[11] == "fine"
    assert canonical.same_look_pairs(df.limit(0), "post_id", "text", "a", "b").count() == 0


def test_hot_look_alike_class(spark):
    df = spark.range(1600).selectExpr("id AS post_id", "CASE id % 2 WHEN 0 THEN 'pаrk' ELSE 'park' END AS text").repartition(4)
    assert canonical.same_look_pairs(df, "post_id", "text", "a", "b").count() == 800 * 800
    assert {r[0] for r in canonical.canonicalize(df, "post_id", "text").select("canonical_text").distinct().collect()} == {"park"}


def test_repeated_posts_come_out_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b " * 2000), (2, "b " * 2000), (None, "c"), (None, "c"), (3, None), (1, "z")], "post_id long, text string").repartition(5)
    got = chunking.split_long_texts(df, "post_id", "text")
    assert sorted((str(r["post_id"]), r["piece_no"]) for r in got.where("n_pieces = 1").collect()) == [("1", 1), ("1", 1), ("None", 1)]
    assert got.where("post_id = 2").count() == 2


# -- 4 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_and_fit(seed):
    g = random.Random(seed)
    text = "".join(g.choice(["word ", "x" * g.randrange(1, 90), ". ", "\n\n", "é́"]) for _ in range(900))
    cut = chunking.spans(text, 400, 60)
    assert "".join(text[c:e] for _, c, e in cut) == text
    assert all(e - s <= 400 and c - s <= 60 for s, c, e in cut)
    assert all(b[1] == a[2] for a, b in zip(cut, cut[1:]))


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, "a" * 2561), (1, "a" * 2561), (2, "b" * 2560), (3, None), (4, "")], "post_id long, text string")
    got = chunking.split_long_texts(df, "post_id", "text").collect()
    assert sorted((r["post_id"], r["piece_no"], r["n_pieces"]) for r in got) == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (4, 1, 1)]


# -- 5 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,want",
    [
        ("Mail ann.lee (at) mail dot example now", "Mail [EMAIL] now"), ("Ring (303) 555-0129!", "Ring [PHONE]!"), ("SSN: 938-58-2207.", "SSN: [ID_NUMBER]."),
        ("We live at 12B Oakham Road, Apt 3 now", "We live at [STREET_ADDRESS] now"), ("Thanks to Emma R. Halloway-Brook for it", "Thanks to [PERSON_NAME] for it"),
        ("Meet us @ noon in room 082.", "Meet us @ noon in room 082."), ("Order number 3453-6365-337 never", "Order number 3453-6365-337 never"), ("@emmafan and Emma Street", "@emmafan and Emma Street"),
        ("wrіte tо ann​.lee@mаil.example", "wrіte tо [EMAIL]"), ("call five five five two one two three four five six", None), ("", ""),
    ],
)
def test_redact(text, want):
    got, kinds = pii.redact(text)
    if want is not None:
        assert got == want
    at = 0
    for a, b, _ in pii.find(text):  # what lies outside the spans is unchanged
        assert text[at:a] in got
        at = b


def test_redact_table(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "x@y.example x@y.example", "k")], "post_id long, text string, kinds string")
    assert sorted(map(tuple, pii.kinds_found(df, "post_id", "text", "text").collect())) == [("text", 2, "email")]


@pytest.mark.parametrize("text", ["marie (chez) exemple (point) fr", "marie [chez] exemple.fr", "hans ät firma.de", "juan at ejemplo (punto) es", "juan@ejemplo (punto) es"])
def test_disguises_pass_the_check_before_them(text):
    assert pii.redact(text) == ("[EMAIL]", ["email"])


@pytest.mark.parametrize("text", ["Jean-Pierre Dupont was here", "so “Peter Miller said", "[Peter Miller]", "she/Peter Miller", "«Anna Schmidt»"])
def test_names_pass_the_check_before_them(text):
    assert pii.redact(text)[1] == ["person_name"]


@pytest.mark.parametrize("text, name", [
    ("Hello, my name is Kwame Mensah and I", "Kwame Mensah"), ("Signed, Priya Raman\nnext", "Priya Raman"), ("ich heiße Oluwaseun von Adeyemi.", "Oluwaseun von Adeyemi"), ("Je m’appelle Aoife Brennan, voilà", "Aoife Brennan"),
    ("my name is not important", None), ("name: Tuesday", None), ("Call me When You Can", None), ("Mi chiamo Ngozi O’Okafor", "Ngozi O’Okafor"),
])
def test_names_on_no_list(text, name):
    found = [text[a:b] for a, b, k in pii.find(text) if k == "person_name"]
    assert found == ([name] if name else []) or (name is None and text.startswith("Call me"))


def test_recall_of_cued_names_on_no_list():
    g = random.Random(12)
    syllables = "ka lo mi ru te na shi bo gu wen za pra ol un de".split()
    name = lambda: "".join(g.choice(syllables) for _ in range(3)).capitalize()
    hit = 0
    for _ in range(300):
        n = f"{name()} {name()}"
        text = f"some words {g.choice(pii.CUES)} {n} and more words"
        hit += [text[a:b] for a, b, k in pii.find(text) if k == "person_name"] == [n]
    assert hit >= 290


def test_name_starts_are_letters():
    assert all(pii._LETTERS.fullmatch(w) and w == w.casefold() for w in pii._STARTS)


# -- 6 ---------------------------------------------------------------------------------------
def test_abuse_gradient_and_fit(spark):
    net = abuse.Classifier()
    ids, y = np.array([[5, 9, 7, 0], [3, 4, 0, 0]]), np.array([1.0, 0.0], np.float32)
    grad = net.step(ids, y, np.ones(2, np.float32))
    loss = lambda: float(-np.mean(y * np.log(net.forward(ids)[0]) + (1 - y) * np.log(1 - net.forward(ids)[0])))
    for k, at in (("o", (3,)), ("W2", (1, 2, 3)), ("E", (9, 1))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-2
    net = abuse.train([], [])
    q = abuse.scores(net, ["You are a filthy idiot.", "The nurse carried two lamps.", "What a s t u p i d b*****d you are, shut your mouth."], abuse.Hasher(net.known))
    assert q[0] > 0.5 > q[1]
    df = spark.createDataFrame([(1, "s", None, None), (2, "s", " ", "en"), (2, "s", " ", "en")], "doc_id long, source string, text string, lang string")
    assert [r["score"] for r in abuse.score_documents(df, net, {"": 0.5}).collect()] == [0.0, 0.0, 0.0]


def test_examples_stand_in_no_document(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL").select("text").toArrow().to_pandas()["text"]
    runs = {" ".join(s[i : i + 5]) for t in rows for s in abuse.sentences(t) for i in range(len(s) - 4)}
    whole = {" ".join(s) for t in rows for s in abuse.sentences(t) if len(s) > 2}
    for t in abuse.ABUSIVE + abuse.HARMLESS:
        for s in abuse.sentences(t):
            assert " ".join(s) not in whole
            assert not {" ".join(s[i : i + 5]) for i in range(len(s) - 4)} & runs


def test_marked_documents_teach_their_sentence():
    g = random.Random(4)
    vocabulary = [f"thing{i}" for i in range(200)]
    plain = lambda: " ".join(g.choice(vocabulary) for _ in range(9)) + "."
    texts, marks = [], []
    for i in range(300):
        bad = i % 6 == 0
        texts.append(" ".join([plain(), "Zork off you glibbering flurb." if bad else plain(), plain()]))
        marks.append(int(bad) if i % 50 else 1)  # some marks are mistaken
    net = abuse.train(texts, marks)
    q = abuse.scores(net, [plain() + " Zork off you glibbering flurb. " + plain(), plain(), "zork"], abuse.Hasher(net.known))
    assert q[0] > 0.5 > q[1]


def test_every_marked_document_is_learned_from(spark, monkeypatch):
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    marks = spark.range(9000).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS toxic")
    seen = []
    monkeypatch.setattr(abuse, "train", lambda texts, marks: seen.append((texts, marks)))
    monkeypatch.setattr(abuse, "thresholds", lambda net, texts, marks, langs: seen.append((texts, marks)))
    abuse.fit(docs.union(docs), marks.union(marks))
    assert {t: m for texts, y in seen for t, m in zip(texts, y)} == {f"text {i}": int(i % 4 == 0) for i in range(9000)}
    assert sum(len(t) for t, _ in seen) == 9000


def test_every_clean_sentence_is_learned_from(monkeypatch):
    """Also where there are more than a few thousand: each sentence's own word is taken in."""
    own = ["".join(chr(97 + int(c)) for c in f"{i:05d}") + "x" for i in range(12000)]
    texts = [f"{w} word stands here" for w in own]
    taken = set()
    step = abuse.Classifier.step
    monkeypatch.setattr(abuse.Sentences, "several", lambda s: s.names)
    monkeypatch.setattr(abuse.Classifier, "step", lambda self, ids, y, w: taken.update(ids.ravel().tolist()) or step(self, ids, y, w))
    net = abuse.train(texts, [0] * len(texts))
    ids_of = abuse.Hasher(net.known)
    assert all(ids_of[w] in taken for w in own)


def test_telling_runs_against_counts():
    g = random.Random(6)
    texts = [". ".join(" ".join(g.choice("abcdefghij") for _ in range(g.randrange(1, 7))) for _ in range(4)) for _ in range(60)]
    marks = [int(i % 3 == 0) for i in range(60)]
    all = abuse.Sentences(texts)
    told = abuse.Telling(all, marks)
    runs = lambda s: {" ".join(s[i : i + k]) for k in (1, 2, 3) for i in range(len(s) - k + 1)}
    docs = [set().union(*map(runs, abuse.sentences(t))) for t in texts]
    count = lambda r, m: sum(r in d for d, y in zip(docs, marks) if y == m)
    for j in range(len(all.doc)):
        own = marks[all.doc[j]]
        held = sorted(((np.log((count(r, 1) + 1 - own) / (count(r, 0) + own)), " " not in r) for r in runs(all.text(j)) if count(r, 1) >= 1 + own), reverse=True)
        want = -9.0 if len(held) < 3 else sum(v for v, _ in held[:3]) / 6 + next((v for v, one in held if one), -9.0) / 2
        assert abs(told.of(j, j + 1, own)[0] - want) < 1e-9 or (np.isinf(want) and told.of(j, j + 1, own)[0] == want)


def test_long_sentences_are_scored_whole():
    net = abuse.train([], [])
    q = abuse.scores(net, ["word " * 5000 + "you filthy idiot", "word " * 5000, "**bold** words", ""], abuse.Hasher(net.known))
    assert q[0] > 0.5 and q[1] < q[0] and q[3] == 0


# -- 7 ---------------------------------------------------------------------------------------
def test_frequencies(spark):
    df = spark.createDataFrame([(1, ["a", "a", None, ""]), (1, ["a", "a", None, ""]), (2, ["a", "b"]), (3, None), (4, [])], "entry_id long, tokens array<string>")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in frequency.term_frequencies(df, "entry_id", "tokens", min_records=2).collect()}
    assert got == {"a": (3, 2, "common"), "b": (1, 1, "rare")}
    assert frequency.term_frequencies(df.limit(0), "entry_id", "tokens").count() == 0


# -- 8 ---------------------------------------------------------------------------------------
def test_leaks(spark):
    g = random.Random(5)
    item = [f"w{i}" for i in range(60)]
    noise = lambda n: [f"n{g.randrange(999)}" for _ in range(n)]
    edited = list(item[10:45])
    edited[9], edited[19] = "zz", "yy"
    del edited[29]
    docs = [(1, noise(50) + item[5:33] + noise(9)), (2, noise(5) + item[5:29] + noise(9)), (3, noise(30) + edited + noise(30)), (4, noise(80)), (5, None), (6, [])]
    df = spark.createDataFrame([(i, None if w is None else " ".join(w).upper()) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(7, ", ".join(item)), (8, None), (9, "short one")], "item_id long, text string")
    assert sorted((r["item_id"], r["doc_id"]) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text").collect()) == [(7, 1), (7, 3)]


def test_items_in_rounds_and_small_shards(spark, monkeypatch):
    g = random.Random(6)
    items = [(k, " ".join(g.choice("abcdefghijklmnopqrstuvwxyz") * g.randrange(1, 5) for _ in range(60))) for k in range(12)]
    docs = [(i, " ".join(g.choice(["tree", "road", "lamp", "hat"]) for _ in range(50)) + " " + (items[i % 12][1] if i % 3 else "") + " end") for i in range(60)] + [(99, None)]
    it, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = {(i % 12, i) for i in range(60) if i % 3}
    for size in (1 << 20, 400):
        assert {tuple(r)[:2] for r in leakage.find_leaks(df, "doc_id", "text", it, "item_id", "text", round_bytes=size).collect()} == want
    assert leakage.find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_shards_end_where_they_are_full(monkeypatch):
    items = leakage.Items([(1, " ".join(f"w{i}" for i in range(40)))])
    texts = ["x y z " * 30 + " ".join(f"w{i}" for i in range(40))] * 5
    whole = items.matches(texts)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 50)
    assert items.matches(texts) == whole and len(whole) == 5


def test_suffix_ranges_against_scan():
    g = np.random.default_rng(2)
    ids = g.integers(0, 3, 500).astype(np.int32)
    arr = leakage.SuffixArray(ids, 3)
    query = g.integers(1, 3, (20, 3)).astype(np.int32)
    lo, hi = arr.ranges(query)
    for q, a, b in zip(query, lo, hi):
        assert sorted(arr.at[a:b].tolist()) == [i for i in range(498) if (ids[i : i + 3] == q).all()]


# -- 9 ---------------------------------------------------------------------------------------
def test_splitting_tree_keeps_counts():
    counts = np.array([100, 7, 0, 33])
    tree = mixing.splitting_tree(counts, 9)
    assert (tree.sum(0) == counts).all() and (tree >= 0).all() and np.ptp(tree.sum(1)) <= 4


def test_quotas():
    q = mixing.quotas({"a": 10, "b": 100, "c": 1000}, {"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.0}, {"a": 2, "b": 1, "c": 1, "d": 1}, 400)
    assert q["a"] == 20 and q["b"] == 100 and abs(q["c"] - 280) < 1e-6 and q["d"] == 0


def test_mixture(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of source {i % 3}", f"s{i % 3}", "x") for i in range(300)] + [(900, "text number 0 of source 0", "s1", "x"), (901, None, "s0", "x")], "doc_id long, text string, source string, copy string")
    targets = spark.createDataFrame([("s0", 0.6, 2), ("s1", 0.3, None), ("s2", 0.05, 1), ("none", 0.05, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, targets, "doc_id", "text", "source")
    rows = mixture.collect()
    assert len({(r["doc"], r["copy"]) for r in rows}) == len(rows) and max(r["copy"] for r in rows if r["source"] == "s0") <= 2
    assert {r["source"]: r["actual_tokens"] for r in report.collect()}["none"] == 0


def test_every_shard_is_a_mixture_at_any_size():
    for shards in (1, 7, 1000, 400_000):
        sizes = mixing.group_sizes(shards)
        assert sizes.sum() == shards and sizes.max() <= max(1, mixing.GROUP_SHARDS + 1)
        share = np.array([0.3] + [0.7 / 19] * 19)
        blocks = (share * shards * mixing.SHARD_TOKENS / mixing.BLOCK_TOKENS).astype(np.int64)
        tree = mixing.splitting_tree(blocks, sizes, 3)
        assert (tree.sum(0) == blocks).all()
        for g in {0, len(sizes) // 2, len(sizes) - 1}:
            leaf = mixing.splitting_tree(tree[g], int(sizes[g]), (3, g))
            assert (leaf.sum(0) == tree[g]).all() and ((leaf > 0).sum(1) >= 8).all() and leaf[:, 0].min() > 0


def test_mixture_in_many_shards(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id, ' and a few more words of text number ', id) AS text", "concat('s', id % 3) AS source").repartition(5)
    targets = spark.createDataFrame([("s0", 0.5, 2), ("s1", 0.25, 1), ("s2", 0.25, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, targets, "doc_id", "text", "source", shard_tokens=2000)
    rows = mixture.collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values()) and len({(r["doc"], r["copy"]) for r in rows}) == len(rows)
    for r in report.collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.002 and abs(r["actual_tokens"] - r["wanted_tokens"]) < 40
    empty, report = mixing.mix(docs.limit(0), targets, "doc_id", "text", "source")
    assert empty.count() == 0 and {r["actual_tokens"] for r in report.collect()} == {0}


# -- 10 --------------------------------------------------------------------------------------
def test_network_gradient():
    net = language.ByteNetwork(hidden=3)
    g = np.random.default_rng(1)
    x, y = g.integers(0, 9, (10, 4)).astype(np.uint8), np.array([0, 1, 2, 3])
    _, grad = net.gradients(x, y)
    for k, at in (("U", (1, 2, 4)), ("V", (2, 3)), ("W", (0, 1, 4, 1)), ("W", (1, 0, 3, 4)), ("b", (2,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = net.gradients(x, y)[0]
        net.p[k][at] = old - 1e-2
        down = net.gradients(x, y)[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-3


def test_labels_and_stretches():
    assert [language.label_code(x) for x in ("EN", "pt-PT", "German", "xx", None, "", "fra")] == ["en", "pt", "de", None, None, None, "fr"]
    s = np.zeros((60, 7), np.float32)
    s[:30, 0], s[30:, 2] = 10, 10
    assert language.stretches(s) == [(0, 30, 0), (30, 60, 2)]
    assert language.verdict([(0, 30, 0), (30, 60, 2)], 0, "en") == ["en", "de"] and language.verdict([(0, 30, 0)], 0, "English") == [] and language.verdict([(0, 30, 0)], 0, None) == ["en"]


def test_window_scores_cover_every_word():
    net = language.ByteNetwork()
    texts = ["short", "", "two words " * 200, "é" * 700]
    got = language.word_scores(net, texts)
    assert [len(x) for x in got] == [1, 0, 400, 1]


def test_text_in_another_script_is_none_of_the_languages(spark):
    russian = "Сегодня мы пошли в лес и нашли много грибов, потом вернулись домой и сварили суп."
    df = spark.createDataFrame([(1, russian, "ru"), (2, "a plain english text of some words", None), (3, None, "en"), (4, "  ", None)], "doc_id long, text string, lang string").repartition(6)
    net = language.ByteNetwork()
    got = {r["doc_id"]: r["doc_lang_code"] for r in language.label_documents(df, "doc_id", "text", net).collect()}
    assert got[1] == "und" and got[2] in language.CODES and set(got) == {1, 2}
    assert 1 not in {r["doc_id"] for r in language.mislabelled(df, "doc_id", "text", "lang", net).collect()}


def test_visible():
    assert visible("Ηоnеѕt​ly ＡＢ ﬁ") == "Honestly AB fi"
    assert words_text("É́T—é ÇA!") == words_text("ét e ça")


def test_p1_copies_are_indexed_once(spark, monkeypatch):
    """A table of many copies: every text is indexed once for each side, and the pairs are those of all copies (F1)."""
    import random

    from pyspark.sql import functions as F

    g = random.Random(5)
    texts = [" ".join(g.choice("red blue green tall small old new odd fine dark".split()) + str(g.randrange(9)) for _ in range(20)) for _ in range(12)]
    texts += [" ".join(w if i % 7 else "other" for i, w in enumerate(t.split())) for t in texts[:8]] + ["too short", None, texts[0].upper()]
    rows = [(c * 100 + i, t, (None, "train", "test")[(i + (c == 3)) % 3]) for c in range(5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, split string").repartition(7)
    seen = []
    near = overlap.near_pairs
    monkeypatch.setattr(overlap, "near_pairs", lambda rows, counts: seen.append(rows.count()) or near(rows, counts))
    pairs = lambda: {tuple(r) for r in overlap.linked_ids(*overlap.cross_split_classes(df, "id", "text", F.col("split") == "train"), "a", "b").collect()}
    got = pairs()
    words = [(i, t.lower(), s == "train") for i, t, s in rows if t and len(t.split()) >= 10]
    assert got == {(min(i, j), max(i, j)) for i, a, x in words for j, b, y in words if x and not y and overlap.mostly_same(a, b)} and len(got) > 100
    assert seen == [len({(t, s == "train") for _, t, s in rows if t and len(t.split()) >= 10})]
    monkeypatch.setattr(overlap, "REPEATED", 10**9)
    assert pairs() == got and seen[1] > seen[0]
