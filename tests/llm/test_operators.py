"""Operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontam, html_text, linededup, mixing, neardup, pii, quality, secrets, toxicity, warc

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sid string, band long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", "  \t ", "one", "one two", "ONE two", "x" * 3000]
    for _ in range(12):
        base = say(r.randint(20, 120)).split(" ")
        texts += [" ".join(base)] * r.randint(1, 3)
        for _ in range(4):
            edited = list(base)
            for _ in range(r.randint(1, 3)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            texts.append(" ".join(edited) + ("\n" + say(12)) * r.randint(0, 2))
    out = [(i, t, "en", r.choice(["a", "b", "c", None]), len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return [*out, out[10], (None, texts[9], "en", "a", 0, "x", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _components(sets, num):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= num * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(docs, rows):
    sets = []
    for row in rows:
        w = WS.findall(_lower(row[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = _components(sets, 85)
    least = defaultdict(lambda: None)
    for row, c in zip(rows, comp, strict=True):
        if row[0] is not None and (least[c] is None or row[0] < least[c]):
            least[c] = row[0]
    want = Counter((row[0], len(s), least[c], least[c] == row[0]) for row, s, c in zip(rows, sets, comp, strict=True))
    assert Counter(map(tuple, neardup.near_duplicates(docs).collect())) == want
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(docs, rows):
    lines = defaultdict(list)
    seen = {(r[0], r[1]) for r in rows}
    for i, t in seen:
        for no, line in enumerate((t or "").split("\n")):
            if s := " ".join(x for x in re.split(r"[ \t\r\x0b\x0c]+", _lower(line)) if x):
                lines[s].append((i is None, i or 0, no, t))
    names = list(lines)
    comp = _components([{s[j : j + 7] for j in range(len(s) - 6)} or {s} for s in names], 80)
    groups = defaultdict(list)
    for s, c in zip(names, comp, strict=True):
        groups[c] += lines[s]
    gone = {(x[0], x[1], x[3], x[2]) for g in groups.values() for x in sorted(g)[1:]}
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = Counter()
    for r in rows:
        key, ls = (r[0] is None, r[0] or 0, r[1]), (r[1] or "").split("\n")
        kept = [x for no, x in enumerate(ls) if (*key, no) not in gone]
        want[(r[0], r[1] if len(kept) == len(ls) else "\n".join(kept), len(ls) if r[1] else 0, len(ls) - len(kept))] += 1
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == want
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    size = lambda t: len(WS.findall(t or ""))
    total, sums = sum(size(r[1]) for r in rows), Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left, w = 1.5 * total - sum(2 * sums[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sums[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sums[s]}
        if not over:
            break
        full |= over
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for g in got:
        assert g.taken <= 2 * g.size and g.source_size == sums[source[g.doc_id]] and g.target == pytest.approx(target[source[g.doc_id]])
        taken[source[g.doc_id]] += g.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 30
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, rows):
    items = [(1, rows[9][1]), (2, "One  two!"), (3, None), (4, "..."), (10, rows[14][1]), (10, rows[14][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = rx.findall(_lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    want = Counter()
    for r in rows:
        w, hit, named = rx.findall(_lower(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    named |= found
        want[(r[0], len(w), len(hit), tuple(sorted(named)), len(named), bool(hit))] += 1
    got = decontam.contaminated_documents(docs, bench).collect()
    assert Counter((g[0], g[1], g[2], tuple(g[3]), g[4], g[5]) for g in got) == want
    assert not any(g.contaminated for g in decontam.contaminated_documents(docs, bench.limit(0)).collect())
    assert decontam.contaminated_documents(docs.limit(0), bench).count() == 0


def test_quality(spark, docs, rows):
    got = quality.text_statistics(docs).collect()
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WS.findall(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        ls = [x for x in t.split("\n") if WS.search(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit))] += 1
    assert Counter(tuple(g)[:6] for g in got) == want
    text = "a b c d e f a b c d e x a b c d e"
    one = quality.text_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert one.n_repeat_words == 15
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn_rules(docs, labels) == []
    clean = " ".join(f"word{i}" for i in range(40))
    data = spark.createDataFrame([(i, clean if i % 2 else clean + " ###" * 30) for i in range(400)], "doc_id long, text string")
    rules = quality.learn_rules(data, data.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert {r.doc_id % 2 for r in quality.apply_rules(data, rules).where("rule_label = 0").collect()} == {0}


def test_personal_data(docs, rows, spark):
    text = "Mail a.b@c.org, 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111, +1 (377) 555-7713. My name is Eva Lang."
    one = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    assert [text[s.start : s.end] for s in one.spans] == ["a.b@c.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (377) 555-7713", "Eva Lang"]
    want = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in one.spans[:4])
    assert one.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.find_personal_data(docs).count() == len(rows)
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab@.-% 1") for _ in range(r.randint(0, 25)))
        assert pii._emails(t) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


def test_main_text():
    tree = html_text.train_blocks()
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy it</div><article><h1>A &amp; B</h1><p>Some <b>bold\n words.<br>More<p>End.<div class=comments><p>I agree with it all.</div></article><footer>c</footer>"
    assert html_text.main_text(page, tree) == "A & B\n\nSome bold words. More\n\nEnd."
    assert html_text.main_text("", tree) == ""


def test_archives(spark):
    pages = [(1, "u", "same"), (2, "u", "same"), (3, "v", None), (4, "v", ""), (5, None, "é" * 5000), (2, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in warc.archive_pages(df).collect())
    first: dict = {}
    want = Counter()
    for i, _, h in sorted(pages, key=lambda x: x[0]):
        b = (h or "").encode()
        want[(i, len(b), warc.base32_sha1(b), "revisit" if b in first else "response", first.get(b))] += 1
        first.setdefault(b, i)
    assert got == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_secrets(spark, docs, rows):
    forest = secrets.train_forest(spark)
    text = 'the commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 and a token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" there'
    one = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), forest).first()
    assert one.n_candidates == 2 and [s.value[:4] for s in one.secrets] == ["f3ef"]
    assert secrets.scan_secrets(docs, forest, path_col="source").count() == len(rows)


def test_toxicity(spark, docs, rows):
    data = [(i, f"a plain sentence number {i}. " + ("you vile fool. " if i % 3 == 0 else "a kind remark. ") + "the end.", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df, df)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert sum((scored[i].score >= 0.3) == bool(y) for i, _, y in data) >= 295
    spot = toxicity.locate_toxic_sentences(df.where("doc_id = 0"), model).first()
    assert "vile fool" in data[0][1][spot.start : spot.end]
    none = toxicity.train_toxicity(docs, df.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, none).collect()) and toxicity.score_toxicity(docs, none).count() == len(rows)
