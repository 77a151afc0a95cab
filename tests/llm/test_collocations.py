"""Collocations against plain Python, with tries that burst and spill."""

import random
import re
from collections import Counter

import pytest

from aislemap.llm import collocations as cl


def brute(docs, longest=5, least=100, best=2000):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    frequent = {p: n for p, n in count.items() if n >= least}
    out = []
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(q[0] == lang and len(q[1]) > len(p) and n >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, n in frequent.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    rows = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        rows += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine[:best])]
    return sorted(rows)


def corpus():
    rng = random.Random(4)
    words = ["the", "The", "of", "and", "new", "york", "é", "x\x01y", "ß", "a"]
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "de", None, "und", ""])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", "; "]) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((lang, text + "New York  new york city" * (i % 3)))
    rows += [("en", "to be or not to be " * 40)] * 3 + [("en", None), ("en", ""), (None, "..!"), ("fr", "w " * 20000), ("de", "longword" * 3000)]
    return rows


def frame(spark, rows):
    full = [(i, t, lang, i) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, n long").repartition(5)


@pytest.mark.parametrize("burst,entries,bits", [(4096, 600_000, 24), (2, 20, 8)])
def test_collocations_are_exact(spark, monkeypatch, burst, entries, bits):
    monkeypatch.setattr(cl, "TRIE_ENTRIES", entries)
    monkeypatch.setattr(cl, "MAP_BITS", bits)
    monkeypatch.setattr(cl, "BUFFER", 5000)
    monkeypatch.setattr(cl, "BURST", burst)
    rows = corpus()
    got = sorted(tuple(r) for r in cl.collocations(frame(spark, rows), least=12).collect())
    assert got == brute(rows, least=12) and len(got) > 20


def test_cut_and_empty(spark):
    rows = corpus()
    got = cl.collocations(frame(spark, rows), least=12, best=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least=12, best=3)
    assert cl.collocations(frame(spark, [])).count() == 0 and cl.collocations(frame(spark, [(None, None)])).count() == 0


def test_trie_bursts_and_spills():
    rng = random.Random(5)
    number = lambda: rng.randrange(6).to_bytes(8, "big")
    trie, want, got = cl.HatTrie(burst=3), Counter(), Counter()
    for _ in range(3000):
        run = b"".join(number() for _ in range(4))
        want[run] += 1
        trie.add(run)
        if trie.entries > 200:
            part = list(trie.spill(100))
            assert trie.entries <= 200 and part
            for head, rest, n in part:
                got[head + rest] += n
    runs = list(trie.spill())
    assert [h + r for h, r, _ in runs] == sorted(h + r for h, r, _ in runs) and not trie.root and not trie.entries
    for head, rest, n in runs:
        got[head + rest] += n
    assert got == want


def test_numbers_that_clash_are_replaced(spark, monkeypatch):
    plain = cl._numbers

    def clashing(hashes, lang, seed):
        return plain(hashes, lang, seed) % 2 if seed == 0 else plain(hashes, lang, seed)

    monkeypatch.setattr(cl, "_numbers", clashing)
    rows = [("en", "one two three " * 5)]
    assert sorted(tuple(r) for r in cl.collocations(frame(spark, rows), least=3).collect()) == brute(rows, least=3)
