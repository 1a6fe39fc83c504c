import random
import re

from sepet.llm.license_scan import PHRASES, TEMPLATES, Automaton, Scanner, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_matching_statistics_against_brute_force():
    rng = random.Random(1)
    texts = [[rng.randrange(1, 4) for _ in range(12)] for _ in range(4)]
    automaton = Automaton(texts)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        run = [rng.randrange(1, 5) for _ in range(20)]
        longest = [max(n for n in range(e + 1) if n == 0 or tuple(run[e - n : e]) in known) for e in range(1, 21)]
        want = [(e, longest[e - 1]) for e in range(1, 21) if longest[e - 1] >= 2 and (e == 20 or longest[e] != longest[e - 1] + 1)]
        assert [(e, n) for e, n, _ in automaton.matches(run, 2)] == want
        for e, n, state in automaton.matches(run, 2):
            places = {(t, k + n) for t, x in enumerate(texts) for k in range(len(x)) if x[k : k + n] == run[e - n : e]}
            assert places == set(automaton.places[state])


def plain_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = {}
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found[label] = [k for k in range(len(words)) if words[k : k + len(p)] == p]
    starts = [k for many in found.values() for k in many]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(k for k, v in found.items() if v))


def test_base_against_brute_force(docs_of, odd_texts):
    rng = random.Random(2)
    parts = "mit MIT license License, general public GENERAL-public apache. x é the under released 3".split(" ")
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(200)] + odd_texts
    rows = scan_licenses(docs_of(texts, clash=True), "text", "doc_id").collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(texts[r["ident"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0.0 <= r["score"] <= 1.0
    assert len(rows) == len(texts)


def test_every_wording_is_found_whole_and_with_gaps():
    scanner = Scanner()
    for label, wordings in TEMPLATES.items():
        for text in wordings:
            found = scanner.scan(f"zzz {text.title()} yyy".encode())
            assert label in found["labels"].split(",") and found["score"] == 1.0
            words = text.split()
            if len(words) > 25:
                words[10:10] = ["inserted", "words"]
                del words[20]
                found = scanner.scan(" ".join(words).encode())
                assert label in found["labels"].split(",") and found["score"] > 0.8
                span = next(s for s in found["spans"] if s["label"] == label)
                assert span["first_word"] == 0 and span["end_word"] == len(words)


def test_ordinary_text_has_no_label():
    found = Scanner().scan(b"the software is a work of art and the use of it is to the public in any case")
    assert found["labels"] == "" and found["spans"] == []


def test_own_wordings_and_no_rows(docs_of):
    df = scan_licenses(docs_of(["we love cats and dogs"]), "text", "doc_id", {"pets": ["love cats and dogs"]}, {"cat": "cats"})
    assert df.first()["labels"] == "cat,pets"
    assert scan_licenses(docs_of([]), "text", "doc_id").count() == 0
