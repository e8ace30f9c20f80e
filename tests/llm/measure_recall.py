"""Prints the recall of the bands of op3 and op9: python tests/llm/measure_recall.py DIR, e.g. /root/testdata/sf0.1.

Queries are the documents whose id is divisible by 100, against all documents, and the lines of those, against all
lines. The pairs to be found are those that comparing full sets finds; recall is the share of them with a band key in
common, which is what the operators verify.
"""

import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from textloom.llm import linededup  # noqa: E402
from textloom.llm.common import HashCache  # noqa: E402
from textloom.llm.sketch import band_keys, fast_similarity_sketch, sketch_sets, word_shingle_sets  # noqa: E402


def measure(items, sizes, keys, queries, num):
    """items: hashes of all sets one after the other; (pairs, found) among queries x all with num % similarity or more."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(items)
    sorted_, by = items[order], owner[order]
    start = np.cumsum(sizes) - sizes
    pairs = found = 0
    near = []
    for q in queries:
        own = items[start[q] : start[q] + sizes[q]]
        lo, hi = np.searchsorted(sorted_, own), np.searchsorted(sorted_, own, "right")
        common = np.zeros(len(sizes), np.int64)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            common[by[a:b]] += 1
        ok = 100 * common >= num * (sizes + len(own) - common)
        ok[q] = False
        for o in np.flatnonzero(ok):
            pairs += 1
            hit = bool((keys[q] == keys[o]).any())
            found += hit
            near.append((common[o] / (sizes[o] + len(own) - common[o]), hit))
    low = [h for s, h in near if s < num / 100 + 0.05]
    return pairs, found, len(low), sum(low)


def main(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    ids, texts = t.column("doc_id").to_pylist(), [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
    distinct = {x: i for i, x in reversed(list(enumerate(texts)))}  # exact copies are one class
    at = sorted(distinct.values())
    sets = word_shingle_sets([texts[i] for i in at], 5, HashCache())
    sizes = np.array([len(s) for s in sets])
    keys = band_keys(sketch_sets(sets, 128), 4)
    queries = [k for k, i in enumerate(at) if ids[i] % 100 == 0 and sizes[k]]
    print("op3: pairs, found, of similarity 0.85 to 0.9, found:", *measure(np.concatenate(sets), sizes, keys, queries, 85))
    lines, asked = {}, set()
    for i, x in zip(ids, texts, strict=True):
        for s in linededup._normal_lines(x):
            if s:
                k = lines.setdefault(s, len(lines))
                if i % 100 == 0:
                    asked.add(k)
    lines = list(lines)
    items, sizes, keys = [], [], []
    for i in range(0, len(lines), 500):
        part = lines[i : i + 500]
        h, n = linededup._line_sets(part, 7)
        items.append(h)
        sizes.append(n)
        keys.append(band_keys(fast_similarity_sketch(*linededup._shingles(part, 7), len(part), 96), 4))
    print("op9: pairs, found, of similarity 0.8 to 0.85, found:", *measure(np.concatenate(items), np.concatenate(sizes), np.concatenate(keys), sorted(asked), 80))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
