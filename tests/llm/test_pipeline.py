"""Every stage of the pipeline against brute force, on a small table with clashing columns, nulls and repeated rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from textloom.llm import toxicity

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_lines int, n_dropped string, size string, copies int, _key string, _rows int, key string, kept int, label long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item = say(30)
    texts = [None, "", " \n ", "one"]
    shared = say(12)
    for i in range(160):
        t = "\n".join(say(r.randint(4, 15)) for _ in range(r.randint(1, 5)))
        if i % 4 == 1:
            t += "\nyou vile awful fool. go away"
        if i % 5 == 0:
            t += "\n" + shared
        if i % 23 == 0:
            t += " " + " ".join(item.split()[3:16])
        texts.append(t)
    for i in range(20, 40):
        w = texts[i].split(" ")
        w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    rows = [(i, t, "en", r.choice(["a", "b", None]), len(t or ""), 5, "x", "y", 9, "k", 3, "z", 0, 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[30]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(bool(t and "vile" in t))) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _groups(sets, num):
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


def _lines(rows):
    seen = sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0])
    names, where = {}, defaultdict(list)
    for i, t in seen:
        for no, line in enumerate((t or "").split("\n")):
            if s := " ".join(re.split(r"[ \t\r\x0b\x0c]+", _lower(line).strip())):
                where[names.setdefault(s, len(names))].append((i, no))
    comp = _groups([{s[j : j + 7] for j in range(len(s) - 6)} or {s} for s in names], 80)
    places = defaultdict(list)
    for k, c in enumerate(comp):
        places[c] += where[k]
    gone = {p for ps in places.values() for p in sorted(ps)[1:]}
    out = []
    for r in rows:
        ls = (r[1] or "").split("\n")
        kept = [x for no, x in enumerate(ls) if (r[0], no) not in gone]
        if len(kept) == len(ls):
            out.append(r)
        elif "\n".join(kept):
            out.append((r[0], "\n".join(kept), *r[2:4], len("\n".join(kept)), *r[5:]))
    return out


def _near(rows):
    rows = list(dict.fromkeys(rows))
    words = [WS.findall(_lower(r[1])) for r in rows]
    comp = _groups([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words], 80)
    least = {}
    for r, c in sorted(zip(rows, comp, strict=True), key=lambda x: x[0][0]):
        least.setdefault(c, r)
    return list(least.values())


def _clean(rows, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = lambda t: {tuple(w[i : i + 10]) for w in [rx.findall(_lower(t))] for i in range(len(w) - 9)}
    bad = set().union(*(grams(t) for t in items if t))
    return [r for r in rows if not grams(r[1]) & bad]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = lambda df: [tuple(r) for r in df.collect()]
    kept = {}
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (None, _lines, _near, lambda x: _clean(x, items), None), strict=True):
        before, out = rows(docs), stage(spark, docs, sf_dir)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        got = rows(out)
        if brute:
            assert Counter(got) == Counter(brute(before)), name
            assert len(got) < len(before), name
        if name == "toxicity":
            model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
            assert Counter(got) == Counter(r for r in before if score[r[0]] < 0.3)
            toxic = {r[0] for r in before if r[1] and "vile" in r[1]}
            assert len(toxic & {r[0] for r in got}) <= 0.1 * len(toxic) and {0, 1, 2, 3} <= {r[0] for r in got}
        kept[name] = got
        docs = spark.createDataFrame(got, out.schema) if got else out
    last = corpus_pipeline.STAGES[-1][0]
    sizes = {r[0]: len(WS.findall(r[1] or "")) for r in kept["benchmark decontamination"]}
    at = {c: i for i, c in enumerate(out.columns)}
    assert out.columns[-4:] == ["size", "target", "copies", "taken"] and len(set(out.columns)) == len(out.columns)
    taken = Counter()
    for r in kept[last]:
        assert r[at["size"]] == sizes[r[0]] and r[at["copies"]] in (1, 2) and r[at["taken"]] == r[at["copies"]] * r[at["size"]]
        taken[r[at["source"]]] += r[at["taken"]]
    for r in kept[last]:
        assert abs(taken[r[at["source"]]] - r[at["target"]]) <= 60
    assert len({r[0] for r in kept[last]}) == len(kept[last])
    assert Counter(rows(corpus_pipeline.run(spark, sf_dir))) == Counter(kept[last])


def test_empty_and_narrow_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    narrow = docs.select("doc_id", "text", "source")
    for _, stage in corpus_pipeline.STAGES:
        narrow = stage(spark, narrow, sf_dir)
    assert narrow.columns == ["doc_id", "text", "source", "size", "target", "copies", "taken"] and narrow.count()
