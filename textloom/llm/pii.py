"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give e-mail addresses, IP addresses, payment cards and telephone numbers. The field, trained here from a
small labelled table, adds spans the patterns miss: names, street addresses, national identity and account
numbers. Decoding is exact Viterbi in numpy, over batches of chains.

A chain is a sentence: it ends with the line, or after a word with a full stop, exclamation or question mark that is
neither a title nor an initial. In a chain whose every word scores O above all else by more than transitions can win back, no span
can pay, so all its labels are O and it is not decoded; all other chains are decoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, slices, small

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long words cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in BASE_KINDS, then by start; code points."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


#: The labelled table. Words of a line, those in brackets are a span of the kind after the bracket.
LABELLED = """
Please ask [Mr. John Smith]name about the invoice .
Yesterday [Mrs. Anna Miller]name called us again .
The letter from [Dr. Peter Novak]name was short and clear .
We met [Ms. Laura Brown]name in the hall .
A note by [Prof. Maria Keller]name came first .
Then [Mr. Green]name left the room .
She wrote to [Dr. Weber]name last week .
My name is [Alice Cooper]name and I live here .
Sincerely , [Robert King]name
Hello , my name is [Tom Baker]name .
He said that his name is [Daniel Stone]name today .
Contact [Mr. Ivan Petrov]name or the desk .
Dear [Mrs. Julia White]name , thank you for the parcel .
Please contact [Susan Clark]name before Friday .
The keys belong to [David Jones]name and nobody else .
I spoke with [Emma Wilson]name about the lease .
[Michael Turner]name wrote the second part of the report .
The parcel was signed by [Sarah Hughes]name at noon .
Ask [Paul]name or [Helen Moore]name for the code .
Best wishes , [Thomas Reed]name
The winner is [Carlos Ruiz]name from the north .
Our guide , [Laura Bianchi]name , knew every stone .
Bitte fragen Sie [Herrn Klaus Bauer]name nach dem Schlüssel .
Gestern hat [Frau Petra Wagner]name angerufen .
[Herr Vogel]name ist heute nicht im Haus .
Mein Name ist [Stefan Lang]name und ich wohne hier .
Mit freundlichen Grüßen , [Anna Schulz]name
Das Paket geht an [Martin Hoffmann]name .
Madame , [M. Pierre Martin]name est venu hier .
Je m'appelle [Claire Dubois]name et je suis ici .
La lettre de [Mme Sophie Bernard]name est courte .
Nous avons vu [Jean Moreau]name au marché .
El señor llama a [Sr. Pablo Gómez]name cada día .
Me llamo [Lucía Torres]name y vivo aquí .
La carta es de [María Vega]name , creo .
I live at [12 Oak Street]address in the old town .
Send it to [221 Baker Street]address before noon .
The shop at [7 Station Road]address is closed .
Our office is at [1600 Long Avenue]address now .
They moved to [45 Mill Lane]address in spring .
Deliver to [9 High Street]address , please .
Her address is [310 North Park Avenue]address since May .
A fire broke out near [18 Queen Square]address last night .
The letter went to [66 Old Church Road]address by mistake .
Wir wohnen in der [Gartenstraße 14]address im zweiten Stock .
Die Praxis ist jetzt [Bahnhofstraße 3]address .
Er zog in den [Lindenweg 27]address um .
Das Büro liegt am [Rosenplatz 8]address .
J'habite au [8 rue du Port]address depuis mai .
Le bureau est au [112 avenue de la Gare]address .
Elle vit [25 rue des Lilas]address .
Vivo en la [calle Mayor 15]address , tercer piso .
La tienda está en la [calle del Sol 4]address .
My SSN is [123-45-6789]id , keep it safe .
SSN : [987-65-4321]id
His social security number is [321-54-9876]id .
The passport [X1234567]id was found .
Passport number [C7654321]id is not valid .
The account [DE89370400440532013000]id was charged .
IBAN [GB29NWBK60161331926819]id is ours .
Pay to IBAN [FR7630006000011234567890189]id today .
The passport [K9081726]id belongs to [Peter Long]name .
Reisepass [C01X00T47]id liegt im Büro .
Le passeport [18CT02345]id est perdu .
The quick brown fox jumps over the lazy dog .
In 1999 there were 12 of them , and 300 in all .
The Street was long and the Road was dark .
Doctor and patient were both late that Monday .
This is The Title Of A Long Book .
Number 42 is the answer to that .
Und der Mann ging in das Haus .
Der Zug nach München fährt um 12 Uhr ab .
Die Straße ist lang und der Weg ist dunkel .
Alle Kinder spielen im Garten hinter dem Haus .
Les deux enfants sont dans la maison .
La rue est longue et la maison est petite .
En la calle no hay nadie , dice la gente .
Los libros son de la biblioteca de la ciudad .
The New York Times wrote about Paris and Rome .
Section 3 has 14 pages and 2 tables .
Version 2.0 of the License was chosen in 2004 .
token = 0a1b2c3d4e5f6071 is what the log said
It costs 15 dollars at the Market in Spring .
Name the street where it was found .
The account was closed . The passport was lost .
THE WHOLE LINE IS IN CAPITALS !
A - B - C are the 3 grades of 2020-01-15 .
At 12 noon he left . To 300 people it was new .
Address , name and number are to be at the desk .
The order 4711 shipped on 3 May from the North Dock .
Call 12 to reach the Front Desk or the Main Office .
The High Court heard the case in March .
We took Route 66 and then the Old Post Road west .
Build 20 of the Road Map is due in June .
He is The Best . She is The Second .
Is it true ? At last ! To be sure .
Dear Sir or Madam , thank you for the letter .
Mr. and Mrs. are short forms of longer words .
Dr. stands for doctor , as everybody knows .
Hello World is the name of the first program .
Paris , London and Rome are old cities .
with with with with with with with with
and and and the the the the of of of of
to to to at at at at to to in in in in
von von von der der der der und und und
de de de de la la la la la le le le le
is is is is is name name name name name
""".strip()

#: Lines of the same kind that training does not see.
HELD_OUT = """
Please call [Maria Lopez]name when you arrive .
[Herrn Klaus Schneider]name geht es wieder gut .
My passport [X7654321]id and the bag of [John Smith]name are gone .
They live at [14 rue de la Paix]address in the centre .
Yours , [George Hall]name
The driver , [Mr. Adam West]name , was not hurt .
Je suis [Marie Lefevre]name , la voisine .
[Linda Evans]name and [Frank Cole]name were at the door .
Ship it to [77 River Road]address by Monday .
Die Wohnung in der [Schillerstraße 21]address ist frei .
Her SSN [222-33-4444]id was on the form .
IBAN [NL91ABNA0417164300]id please .
We met [Dr. Hanna Koch]name at the station .
El paquete es para [Juan Romero]name .
The house at [5 Elm Avenue]address burned down .
The passport [M2345678]id has expired .
I saw [Elena Rossi]name in [22 Garden Lane]address today .
[Frau Monika Braun]name kommt um drei .
[Mme Julie Petit]name est absente .
Regards , [Kevin Parker]name
The Green Party met on Monday in the Town Hall .
The road to the north was closed for 3 days .
In May 2019 the Second Street Bridge was built .
Der Hund und die Katze schlafen im Garten .
Les 12 maisons de la rue sont vides .
Please call the office before 5 .
La calle es larga y tiene 20 casas .
The passport office is at the end of the hall .
Account number and name are both needed .
Chapter 7 : The Last King Of The North
""".strip()

LABELS = ("O", "B-name", "I-name", "B-address", "I-address", "B-id", "I-id")
KINDS = ("name", "address", "id")
#: Cue words, given names and words of streets.
_TITLES = frozenset("mr mrs ms dr prof herr herrn frau monsieur madame mme mlle m sr sra señor señora".split())
_CUES = {
    **dict.fromkeys("ssn iban passport passeport reisepass pasaporte konto security account".split(), "CUE_ID"),
    **dict.fromkeys("is ist est es are".split(), "CUE_IS"),
    **dict.fromkeys("name sincerely regards wishes yours dear grüßen m'appelle llamo cordialement".split(), "CUE_NAME"),
    **dict.fromkeys("call ask contact with by thank meet met saw".split(), "CUE_WHO"),
    **dict.fromkeys("at to an au en in address near adresse".split(), "CUE_AT"),
    "number": "CUE_NUM",
}
_PARTICLES = frozenset("de la le les du des del der von van di da y of".split())
_GIVEN = frozenset(
    "adam alan alice andrea andreas andrew angela anna anne antonio barbara ben bernd carla carlos carmen caroline catherine charles christian christine claire claudia daniel david diego dieter edward elena elizabeth emily emma eric eva fernando francisco frank françois georg george hanna hans heinz helen henry ingrid ivan jack jacques james jan jane javier jean jennifer joan john jonas jorge josé joseph juan julia julie jürgen karen karin karl kevin klaus laura linda louis lucía luis lukas marco margaret maria maría marie mario mark marta martin mary matthew michael michel miguel monika nicole nina oliver pablo patricia paul pedro peter petra philip philippe pierre rafael richard robert rosa ruth sabine samuel sandra sara sarah simon sofia sophie stefan stephen susan thomas tim tom ursula uwe victor walter werner william wolfgang".split()
)
_STREETS = frozenset("street road avenue lane boulevard square drive strasse straße".split())
_STREETS_BEFORE = frozenset("rue calle avenue avenida boulevard via plaza place".split())
_STREET_ENDS = ("straße", "strasse", "gasse", "weg", "platz", "allee")
#: Punctuation at a word's ends that is no part of it.
_EDGE = ".,;:!?()[]{}\"'«»„“”"


def word_class(word: str) -> str:
    """The shape of a word: what the field knows of it."""
    low = word.lower()
    if word == low and word.isalpha() and word not in _CUES:
        return "PARTICLE" if word in _PARTICLES else "STREET_BEFORE" if word in _STREETS_BEFORE else "LOW"
    core = word.strip(_EDGE)
    low = core.lower()
    if not core:
        return "PUNCT"
    if low in _TITLES and core[0].isupper() and (len(core) > 1 or word.endswith(".")):
        return "TITLE"
    if low in _CUES:
        return _CUES[low]
    if core[0].isupper():
        if low in _GIVEN:
            return "GIVEN"
        if low in _STREETS:
            return "STREET"
        if len(low) > 6 and low.endswith(_STREET_ENDS) and core[1:].islower():
            return "STREET_END"
    elif low in _STREETS_BEFORE:
        return "STREET_BEFORE"
    digits = sum("0" <= c <= "9" for c in core)
    if digits == len(core):
        return f"NUM{min(len(core), 5)}"
    if not digits:
        if core.islower() or not core.isalpha():
            return "LOW"
        return "CAP" if core[0].isupper() and core[1:].islower() else "UP" if core.isupper() and len(core) < 3 else "CAPS"
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", core):
        return "DDD-DD-DDDD"
    if re.fullmatch(r"[A-Z][0-9]{7,8}", core):
        return "XDDDDDDD"
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", core):
        return "XXDD+"
    if re.fullmatch(r"[A-Z0-9]{8,10}", core) and digits >= 4:
        return "XD+"
    return "MIXED"


CLASSES = ("PUNCT", "TITLE", "GIVEN", "PARTICLE", "STREET", "STREET_BEFORE", "STREET_END", "CUE_ID", "CUE_IS", "CUE_NAME", "CUE_WHO", "CUE_AT", "CUE_NUM", *(f"NUM{i}" for i in range(1, 6)), "LOW", "CAP", "UP", "CAPS", "DDD-DD-DDDD", "XDDDDDDD", "XXDD+", "XD+", "MIXED", "EDGE")
_INDEX = {c: i for i, c in enumerate(CLASSES)}
_NC, _NL = len(CLASSES), len(LABELS)


def read_labelled(table: str = LABELLED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, labels) of each line of the labelled table."""
    out = []
    for line in table.split("\n"):
        words, labels, kind = [], [], None
        for piece in re.split(r"(\[[^\]]*\][a-z]+)", line):
            m = re.fullmatch(r"\[([^\]]*)\]([a-z]+)", piece)
            inside = (m[1] if m else piece).split()
            kind = m and m[2]
            words += inside
            labels += [LABELS.index(f"{'I' if i else 'B'}-{kind}") if kind else 0 for i in range(len(inside))]
        out.append((np.array([_INDEX[word_class(w)] for w in words]), np.array(labels)))
    return out


def _emissions(classes: np.ndarray, model: dict) -> np.ndarray:
    """Scores of each label for each word of one chain, from its class and its two neighbours' on either side."""
    edge = _INDEX["EDGE"]
    pad = np.concatenate(([edge, edge], classes, [edge, edge]))
    n = len(classes)
    return sum(model["unary"][d][pad[d : d + n]] for d in range(5))


def train_crf(table: str = LABELLED, rounds: int = 300, rate: float = 0.1, l2: float = 5e-3) -> dict:
    """Maximum conditional likelihood by gradient ascent (forward-backward), with an L2 penalty. Deterministic."""
    chains = read_labelled(table)
    model = {"unary": np.zeros((5, _NC, _NL)), "pair": np.zeros((_NL, _NL))}
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.items()}
    edge = _INDEX["EDGE"]
    lse = lambda a, axis: (mx := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - mx).sum(axis=axis))
    for step in range(1, rounds + 1):
        g = {k: -l2 * v for k, v in model.items()}
        for classes, labels in chains:
            n, e, t = len(classes), _emissions(classes, model), model["pair"]
            f, b = np.zeros((n, _NL)), np.zeros((n, _NL))
            f[0] = e[0]
            for i in range(1, n):
                f[i] = e[i] + lse(f[i - 1][:, None] + t, 0)
            for i in range(n - 2, -1, -1):
                b[i] = lse(t + (e[i + 1] + b[i + 1])[None, :], 1)
            z = lse(f[-1], 0)
            p = -np.exp(f + b - z)
            p[np.arange(n), labels] += 1
            pad = np.concatenate(([edge, edge], classes, [edge, edge]))
            for d in range(5):
                np.add.at(g["unary"][d], pad[d : d + n], p / len(chains))
            for i in range(1, n):
                pp = np.exp(f[i - 1][:, None] + t + (e[i] + b[i])[None, :] - z)
                g["pair"] -= pp / len(chains)
                g["pair"][labels[i - 1], labels[i]] += 1 / len(chains)
        for k in model:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            model[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
    # Training learns without it, so that each word's own scores tell; decoding lets an I follow its kind's B or I only.
    for i in range(1, _NL):
        if LABELS[i][0] == "I":
            model["pair"][[q for q in range(_NL) if q == 0 or LABELS[q][1:] != LABELS[i][1:]], i] = -1e6
    model["start"] = np.array([-1e6 if x[0] == "I" else 0.0 for x in LABELS])
    # A span of m words has at most m + 1 transitions to, within and from it: less than two a word.
    model["win"] = 2 * max(0.0, float((model["pair"] - model["pair"][0, 0]).max()))
    return model


def viterbi(emissions: np.ndarray, lengths: np.ndarray, model: dict) -> np.ndarray:
    """Best labels of a batch of chains, padded to (chains, longest, labels); entries past a length are 0."""
    n, longest, _ = emissions.shape
    t, back = model["pair"], np.zeros(emissions.shape, np.int8)
    score = emissions[:, 0] + model["start"]
    for i in range(1, longest):
        ways = score[:, :, None] + t[None]
        back[:, i] = ways.argmax(axis=1)
        new = ways.max(axis=1) + emissions[:, i]
        score = np.where((i < lengths)[:, None], new, score)
    out = np.zeros((n, longest), np.int64)
    cur = score.argmax(axis=1)
    rows = np.arange(n)
    for i in range(longest - 1, -1, -1):
        live = i < lengths
        out[live, i] = cur[live]
        cur = np.where(live & (i > 0), back[rows, i, cur], cur)
    return out


class _Classes(dict):
    """word -> twice its class, and one more if it ends a chain; emptied when it has grown to its limit."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        kind = word_class(word)
        tail = word.rstrip(")]}\"'»”")[-1:]
        c = self[word] = 2 * _INDEX[kind] + (tail in ".!?" and tail != "" and kind not in ("TITLE", "UP"))
        return c


def _decoded(lines: list[list[str]], model: dict, cache: dict) -> list[tuple[int, np.ndarray]]:
    """(line, labels) of the lines that have a label other than O."""
    edge = _INDEX["EDGE"]
    n_words = np.array([len(x) for x in lines])
    flat = np.fromiter((c for words in lines for c in map(cache.__getitem__, words)), np.int64, int(n_words.sum()))
    line_of = np.repeat(np.arange(len(lines)), n_words)
    line_at = np.cumsum(n_words) - n_words
    last = (flat & 1).astype(bool)
    last[np.cumsum(n_words) - 1] = True
    ends = np.flatnonzero(last)
    first = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends + 1 - first
    # Two edges part the chains, so neighbours of one chain are never another's words.
    owner = np.repeat(np.arange(len(ends)), lengths)
    spot = np.arange(len(flat)) + 2 * (owner + 1)
    pad = np.full(len(flat) + 2 * len(ends) + 2, edge)
    pad[spot] = flat >> 1
    unary = model["unary"].astype(np.float32)
    e = unary[0][pad[spot - 2]]
    for d in range(1, 5):
        e += unary[d][pad[spot + d - 2]]
    live = e[:, 1:].max(axis=1) - e[:, 0] + model["win"] >= 0
    todo = distinct(owner[live])
    out: dict[int, np.ndarray] = {}
    todo = todo[np.argsort(lengths[todo], kind="stable")]  # of like lengths, so padding stays small
    for part in np.array_split(todo, max(1, int(lengths[todo].sum()) // 50_000)):
        if not len(part):
            continue
        longest = int(lengths[part].max())
        batch = np.zeros((len(part), longest, _NL))
        for r, j in enumerate(part):
            batch[r, : lengths[j]] = e[first[j] : first[j] + lengths[j]]
        for row, j in zip(viterbi(batch, lengths[part], model), part, strict=True):
            if row.any():
                k = int(line_of[first[j]])
                if k not in out:
                    out[k] = np.zeros(n_words[k], np.int64)
                at = first[j] - line_at[k]
                out[k][at : at + lengths[j]] = row[: lengths[j]]
    return list(out.items())


def crf_spans(texts: list[str], model: dict, cache: dict) -> list[list[tuple[str, int, int]]]:
    """For each text (kind, start, end) of the field's spans in code points, without punctuation at the ends."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    owners, starts, raw, lines = [], [], [], []
    for r, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            if words := line.split():
                owners.append(r)
                starts.append(at)
                raw.append(line)
                lines.append(words)
            at += len(line) + 1
    if not lines:
        return out
    for j, labels in sorted(_decoded(lines, model, cache), key=lambda x: x[0]):
        pos, prev, spans = 0, -2, out[owners[j]]
        for i, w in enumerate(lines[j]):
            pos = raw[j].index(w, pos)
            if labels[i]:
                kind, lead = LABELS[labels[i]], len(w) - len(w.lstrip(_EDGE))
                a, b = starts[j] + pos + lead, starts[j] + pos + max(lead, len(w.rstrip(_EDGE)))
                if kind[0] == "I" and prev == i - 1 and spans and spans[-1][0] == kind[2:]:
                    spans[-1] = (kind[2:], spans[-1][1], b)
                else:
                    spans.append((kind[2:], a, b))
                prev = i
            pos += len(w)
    return out


def _finder(model: dict):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Classes()
        for batch in small(batches):
            counts, base, spans = [[] for _ in BASE_KINDS], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices([len(t) for t in texts]):
                for t, own in zip(texts[i:j], crf_spans(texts[i:j], model, cache), strict=True):
                    b = base_spans(t)
                    for k, c in zip(BASE_KINDS, counts, strict=True):
                        c.append(sum(x[0] == k for x in b))
                    base.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest())
                    own.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in b + own])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, kind)], names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return find


def find_personal_data(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans array<struct<kind, start, end>>), a row for each row.

    spans holds the patterns' spans by kind, then by start, then the field's (name, address, id) likewise; spans of
    different kinds may overlap. Offsets are code points, ends exclusive. Null texts are read as empty. Repeated rows
    each return a row. Other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    out = src.mapInArrow(_finder(model or train_crf()), f"id {kind}, {counts}, base_sha256 string, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def spans_text(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
