"""Scores, candidates and blocks against plain versions written from the contracts."""

import html.parser
import math
import random
import re

import pytest
import xxhash

from textloom.llm import html_text, secrets, toxicity
from textloom.llm.trees import tree_value


def test_toxicity_scores(spark):
    """1 - prod(1 - p) over the sentences, p logistic in the weights of words and of their prefixes."""
    r = random.Random(7)
    words = "kind Vile fool remark häuser Straße the and wretched awfully awful x1 naïve".split()
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", ", ", ". ", "! ", "\n", "。", "-"]) for _ in range(n))
    rows = [(i, say(r.randint(0, 40))) for i in range(250)] + [(900, None), (901, ""), (902, "?!. \n"), (903, "awful " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("fool" in (t or ""))) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, labels)
    weight = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))
    got = {g.doc_id: g for g in toxicity.score_toxicity(df, model).collect()}
    for i, t in rows:
        z = []
        for sentence in re.split(r"[.!?\n。]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            ws = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)]
            features = [f for w in ws for f in (b"w" + w, *(b"p" + w[:n] for n in (4, 5, 6, 7, 8) if len(w) > n))]
            z.append(model["bias"] + sum(weight.get(xxhash.xxh32_intdigest(f) % toxicity.DIM, 0.0) for f in features) if ws else -60.0)
        clean = math.prod(1 / (1 + math.exp(min(x, 700))) for x in z)
        assert got[i].score == pytest.approx(1 - clean, abs=1e-9)
        assert got[i].worst_sentence == z.index(max(z)) or got[i].worst_score == pytest.approx(1 / (1 + math.exp(-max(z))), abs=1e-9)
        assert got[i].n_flagged == sum(x > 0 for x in z)


def _candidates(text):
    """(word, value): long runs of every word, else the value that a cue and an assignment introduce."""
    words, out = re.sub(r"[\x20\x09-\x0D]+", " ", text or "").strip(" ").split(" "), []
    for i, w in enumerate(words):
        runs = re.findall(secrets.CANDIDATE, w) if len(w) >= 16 else []
        front = " ".join(words[max(0, i - 3) : i])
        if runs:
            out += [(i, c) for c in runs]
        elif len(w) >= 4:
            inside = re.search(secrets._WITHIN, w) if re.search("[=:].", w) else None
            after = re.search(secrets._VALUE, w) if i and re.search("[=:>\"']$", words[i - 1]) and re.search(secrets._ASSIGN, front.lower()) else None
            if inside and inside[2]:
                out.append((i, inside[2]))
            elif after and after[1]:
                out.append((i, after[1]))
    return out


def test_secret_candidates_and_scores(spark):
    r = random.Random(3)
    pieces = ["password", "PASSWORD=", "token:", "=", ":", '"', "db_pwd=x9Y8z7w6", "api_key='q1w2e3r4t5';", "secret => s3cr3tval", "a1b2c3d4e5f6a7b8c9d0", "a1b2c3d4e5f6a7b8,token=a1b2c3d4e5f6a7b8", "the", "Wort", "auth", "x" * 40, "path/to/some/long/file_name", "\t", "\n", "é=ü", "key", "4111111111111111"]
    texts = [r.choice([" ", "", " "]).join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(400)]
    forest = secrets.train_forest(spark, trees=5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: g for g in secrets.scan_secrets(df, forest, threshold=-1.0).collect()}
    for i, t in enumerate(texts):
        assert [(s.word, s.value) for s in got[i].secrets] == _candidates(t), t
        assert got[i].n_candidates == got[i].n_secrets == len(_candidates(t))
    kept = secrets.scan_secrets(df, forest).collect()
    assert {(k.doc_id, s.word, s.value, s.score) for k in kept for s in k.secrets} == {(i, s.word, s.value, s.score) for i, g in got.items() for s in g.secrets if s.score >= 0.5}


def test_forest_expression_is_the_forest(spark):
    rows = secrets.labelled_findings(seed=9, each=4)
    forest = secrets.train_forest(spark)
    df = spark.createDataFrame([(x["core"], x["before"], x["path"]) for x in rows], "core string, before string, path string")
    x = secrets.candidate_features(df["core"], df["before"], df["path"])
    from pyspark.sql import functions as F

    for g in df.select(x.alias("x")).select("x", secrets.forest_column(forest, lambda k: F.get(F.col("x"), F.lit(k))).alias("score")).collect():
        assert g.score == pytest.approx(sum(tree_value(t, tuple(g.x)) for t in forest) / len(forest))


class _Plain(html.parser.HTMLParser):
    """The text between block tags of a well-formed page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip += 1
        if tag == "br":
            self.parts[-1] += " "
        elif tag in html_text._BLOCK:
            self.parts.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        if tag in html_text._BLOCK:
            self.parts.append("")

    def handle_data(self, data):
        if not self.skip:
            self.parts[-1] += data


def test_blocks_of_well_formed_pages():
    r = random.Random(11)
    words = ["river", "&amp;", "caf&eacute;", "a\n b", "&#x4e2d;", "x &lt; y", "&nbsp;", "1", "<b>bold</b>", "<a href='x>y'>link</a>", "<br>", "<!-- <p>no</p> -->", "<script>var t='</p>';</script>", "<i></i>", "<span class=ad>s</span>"]

    def make(depth):
        out = ""
        for _ in range(r.randint(1, 4)):
            out += " ".join(r.choice(words) for _ in range(r.randint(0, 5)))
            if depth:
                tag = r.choice(["div", "section", "blockquote", "ul", "table", "h2", "article"])
                inner = make(depth - 1)
                out += f"<li>{inner}</li>".join(("<ul>", "</ul>")) if tag == "ul" else f"<table><tr><td>{inner}</td></tr></table>" if tag == "table" else f"<{tag}>{inner}</{tag}>"
        return out

    for _ in range(300):
        page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{make(3)}</body></html>"
        plain = _Plain()
        plain.feed(page)
        plain.close()
        want = [" ".join(p.split()) for p in plain.parts if p.split()]
        assert html_text.main_text(page, 1).split("\n\n") == (want or [""]), page
