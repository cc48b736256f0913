import random
import re

from quarry.llm import license_scan as ls
from tests.llm.data import awkward, clash, empty, frame, prose


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for p, lab in ls.BASE_PHRASES.items():
        q = p.split()
        out += [(i, lab) for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
    return len(w), sorted(out)


def brute_best_run(toks, template):
    return max([0, *(n for i in range(len(toks)) for n in range(1, len(template) + 1)
                     if any(toks[i:i + n] == template[k:k + n] for k in range(len(template) - n + 1)) and i + n <= len(toks))])


def rows():
    mit = ls.TEMPLATES["mit"][1]
    out = awkward(n=10) + [
        (500, "Released under the MIT License, yes under the mit LICENSE."), (501, "cc by nc cc by nc by cc by-nc"),
        (502, "apache license version 2 apache license version 20"), (503, prose(random.Random(1), 9) + " " + mit + " end"),
        (504, mit.replace("sublicense", "my own gizmo")), (505, mit[:200]),
        (506, "This work is licensed under the GNU General Public License, version 3."),
        (507, "under the under the mit license"), (508, "apache\x00license*version+2")]
    return out


def test_base_columns_match_brute_force(spark):
    data = rows()
    got = ls.scan_licenses(clash(frame(spark, data), "labels", "score")).collect()
    want = []
    for i, t in data:
        n, places = brute_base(t)
        want.append((i, n, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                     ",".join(sorted({lab for _, lab in places}))))
    have = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    for r in got:
        assert 0.0 <= r["score"] <= 1.0
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_method_labels(spark):
    got = {r["doc_id"]: r for r in ls.scan_licenses(frame(spark, rows())).collect() if r["doc_id"] and r["doc_id"] >= 500}
    assert got[503]["labels"] == "mit" and got[503]["score"] == 1.0
    assert got[504]["labels"] == "mit" and 0.9 < got[504]["score"] < 1.0   # chained over other words
    assert got[505]["labels"] == "" and 0.2 < got[505]["score"] < 0.8      # part of a notice only
    assert got[506]["labels"] == "gpl-3"                                    # not the other version
    span = got[503]["spans"][0]
    assert (span["first_word"], span["label"]) == (9, "mit")


def test_matching_statistics_match_brute_force():
    rng = random.Random(7)
    templates = {"x": [" ".join(rng.choice("abc") for _ in range(12)) for _ in range(4)]}
    sc = ls.Scanner.build({}, templates)
    texts = [t.split() for ts in templates.values() for t in ts]
    for _ in range(40):
        toks = [rng.choice("abcd") for _ in range(25)]
        ids = [sc.vocab.get(t.encode(), 99) for t in toks]
        stats = sc.automaton.statistics(ids)
        for i, (n, _) in enumerate(stats):
            best = max([0, *(k for k in range(1, i + 2)
                             if any(toks[i + 1 - k:i + 1] == t[j:j + k] for t in texts for j in range(len(t))))])
            assert n == best
        # every maximal match of three tokens or more is found with its place in the template
        _, matches, _ = sc.scan([t.encode() for t in toks])
        want = set()
        for name, t in enumerate(texts):
            for a in range(len(toks)):
                for p in range(len(t)):
                    if toks[a] == t[p] and (a == 0 or p == 0 or toks[a - 1] != t[p - 1]):
                        n = 0
                        while a + n < len(toks) and p + n < len(t) and toks[a + n] == t[p + n]:
                            n += 1
                        if n >= ls.MIN_MATCH:
                            want.add((name, a, p, n))
        assert set(matches) == want


def notices(text):
    sc = ls.Scanner.build(ls.BASE_PHRASES, ls.TEMPLATES)
    toks = ls.tokens_of(text.encode())
    return sc.notices(sc.scan(toks)[1], len(toks), ls.MIN_COVERAGE)


def test_every_place_of_a_notice(spark):
    gpl3, mit = ls.TEMPLATES["gpl-3"][0], ls.TEMPLATES["mit"][1]
    gpl2 = "this software is licensed under the GNU General Public License, version 2"
    rng = random.Random(3)
    far = prose(rng, 50)
    n = len(ls.tokens_of(mit.encode()))
    data = [(1, f"{gpl3} {far} {gpl2}"), (2, f"{gpl3} {gpl2}"), (3, f"{gpl2} {gpl3} {gpl2}"),
            (4, f"{mit} {mit} {far} {mit.replace('sublicense', 'gizmo')}"), (5, f"{far} {mit} {gpl3} {far} {gpl3}")]
    got = {r["doc_id"]: r for r in ls.scan_licenses(frame(spark, data)).collect()}
    spans = {k: sorted((s["first_word"], s["end_word"], s["label"]) for s in r["spans"]) for k, r in got.items()}
    assert got[1]["labels"] == got[2]["labels"] == got[3]["labels"] == "gpl-2,gpl-3"
    assert spans[1] == [(0, 12, "gpl-3"), (64, 74, "gpl-2")]
    assert spans[2] == [(0, 12, "gpl-3"), (14, 24, "gpl-2")]
    assert spans[3] == [(2, 12, "gpl-2"), (12, 24, "gpl-3"), (26, 36, "gpl-2")]
    assert spans[4] == [(0, n, "mit"), (n, 2 * n, "mit"), (2 * n + 50, 3 * n + 50, "mit")]
    assert got[5]["labels"] == "gpl-3,mit" and len(spans[5]) == 3


def test_sibling_notices_label_only_themselves():
    for label, texts in ls.TEMPLATES.items():
        for text in texts:
            assert {h[0] for h in notices(text)} == {label}, text
    nc, by = ls.TEMPLATES["cc-by-nc"][1], ls.TEMPLATES["cc-by"][1]
    nd = nc.replace("NonCommercial", "NonCommercial-NoDerivatives")
    assert notices(f"x {nc}") == [("cc-by-nc", 1, 15, 1.0)]
    assert notices(f"{nc} {by}") == [("cc-by", 14, 27, 1.0), ("cc-by-nc", 0, 14, 1.0)]
    assert {h[0] for h in notices(nd)} == {"cc-by-nc"}


def test_notice_that_stands_many_times():
    got = notices("Released under the MIT License. " * 3000)
    assert [h[1:3] for h in got] == [(5 * i, 5 * i + 5) for i in range(3000)]


def test_empty(spark):
    assert ls.scan_licenses(empty(spark)).collect() == []
