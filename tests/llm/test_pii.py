import random

import numpy as np
import pytest

from weftline.llm import pii

_rnd = random.Random(0)
_syl = lambda n, tail: sorted({_rnd.choice(["Ma", "To", "Be", "Il", "Ne", "Do", "Se", "Am", "Ke", "Vo", "Ta", "Ri"]) + _rnd.choice(["ra", "lin", "sk", "vo", "van", "rit", "sta", "mo", "del", "nu"]) + _rnd.choice(tail) for _ in range(n)})
GIVEN = ["Mara", "Selin", "Rook", *_syl(60, ["", "a", "o", "is"])]
FAMILY = ["Velding", "Marrow", "Osterby", *_syl(140, ["ding", "by", "uli", "ley", "vik", "sari", "row", "gren"])]
KNOWN = [w for i, w in enumerate(GIVEN) if i < 3 or i % 4], [w for i, w in enumerate(FAMILY) if i < 3 or i % 4]
SENT = ["Spoke with {n} about the plan.", "My sister {n} prefers tea.", "Please ask {n} to review it.", "{n} will not be there.", 'note: "{n}" <{e}>', "Mit {n} besprochen.", "The report was signed by {n}.", "Call me on {p}.", "tel. {p}", "I moved to {a}.", "SSN {s} is on file.", "passport no. X0{d}", "mail {e} please", "nobody saw the stale copy.", "The Quiet Lantern agent indexed 912 pages.", "Ask Quiet Lantern whether the limit holds.", "Range 200-300-905 is reserved.", "Epoch 17171492717 is the cut-off.", "project Rook ships from the north.", "Paper Kite restored 1286 rows on Monday."]


def _text(rnd):
    out, truth = [], []
    for _ in range(rnd.randint(2, 6)):
        t = rnd.choice(SENT)
        n = f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}"
        out.append(t.format(n=n, e=f"{n.split()[0].lower()}{rnd.randint(1, 99)}@example.org", p=f"({rnd.randint(201, 989)}) 555-01{rnd.randint(10, 99)}", a=f"{rnd.randint(2, 300)} Old Mill Road", s=f"9{rnd.randint(10, 99)}-2{rnd.randint(1, 9)}-{rnd.randint(1000, 9999)}", d=rnd.randint(1000000, 9999999)))
        for mark, kind in (("{n}", "NAME"), ("{e}", "EMAIL"), ("{p}", "PHONE"), ("{a}", "ADDRESS"), ("{s}", "ID_NUMBER"), ("{d}", "ID_NUMBER")):
            truth += [kind] * t.count(mark)
    return " ".join(out), sorted(truth)


@pytest.fixture(scope="module")
def trained():
    rnd = random.Random(1)
    return pii.prepare([_text(rnd)[0] for _ in range(2500)], *KNOWN)


def test_held_out_accuracy(trained):
    rnd = random.Random(2)
    texts, truths = zip(*[_text(rnd) for _ in range(600)], strict=True)
    right = found = wanted = 0
    for spans, truth in zip(pii.decode(list(texts), *trained), truths, strict=True):
        got = sorted(k for _, _, k in spans)
        for kind in pii.TYPES:
            right += min(got.count(kind), truth.count(kind))
        found += len(got)
        wanted += len(truth)
    assert right / wanted > 0.97 and right / found > 0.97


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to kesta.holvik+news [at] post [dot] example [dot] org now", ["EMAIL"]),
        ("link https://x.invalid/reset?user=besk%2Bp%40example.net&step=3", ["EMAIL"]),
        ("mail lbrenning at example dot net.", ["EMAIL"]),
        ("Use ns.Agent@latest, kit@2.0.8 and user@host", []),
        ("phone=+44 (0)7700 900 537", ["PHONE"]),
        ("ring 030/23125-470 or four one five, five five five, zero one eight nine", ["PHONE", "PHONE"]),
        ("tel. 1-415-555-0172 ext. 17", ["PHONE"]),
        ("```python\n@app.tool\ndef f(): ...\n```", []),
        ("030 1234567 / 0171 2345678 and SSN 912-24-4932 (212) 555-0134", ["PHONE", "PHONE", "ID_NUMBER", "PHONE"]),
        ("mail besk {ät} example.org or besk ( at ) example punkt org", ["EMAIL", "EMAIL"]),
        ("NINO QQ 12 34 56 C and identity card 7997 1151 K", ["ID_NUMBER", "ID_NUMBER"]),
        ("tax id 987260952", ["ID_NUMBER"]),
        ("I live at 16 bis, rue des Trois-Lampes, 00495 Vaumont and Flat 5, 252 Ostwick Terrace, Velmouth VX2 1QT", ["ADDRESS", "ADDRESS"]),
        ("Ich wohne: Mühlgrabenstraße 144, 00132 Tellbach", ["ADDRESS"]),
        ("Home address Calle del Farol 411, 3º B", ["ADDRESS"]),
        ("See section 1040 Lane detection and chapter 209 Road maps.", []),
        ("", []),
        ("​ \n", []),
    ],
)
def test_spellings(trained, text, kinds):
    assert [k for _, _, k in pii.decode([text], *trained)[0] if k != "NAME"] == kinds


def test_names_are_single_stretches(trained):
    for text in ("Spoke with Dr. Mara T. Velding about the plan.", "Please ask Velding, Mara to review it.", "The report was signed by Selin von Marrow-Osterby."):
        spans = [s for s in pii.decode([text], *trained)[0] if s[2] == "NAME"]
        assert len(spans) == 1, text


def test_skip_edges_carry_evidence():
    h = np.array([2.0, -0.2, -3.0])
    alone = pii.propagate(h, np.empty((0, 2), np.int64), np.empty(0))
    linked = pii.propagate(h, np.array([[0, 1]]), np.array([0.8]))
    assert alone[1] < 0 < linked[1] and linked[2] == h[2]
    # exact on a tree: compared with summing over all assignments
    e, j = np.array([[0, 1], [1, 2]]), np.array([0.7, 0.4])
    got = pii.propagate(h, e, j, rounds=60)
    weights = {}
    for a in (-1, 1):
        for b in (-1, 1):
            for c in (-1, 1):
                weights[a, b, c] = np.exp(h @ np.array([a, b, c]) + j[0] * a * b + j[1] * b * c)
    for i in range(3):
        up = sum(w for k, w in weights.items() if k[i] > 0)
        down = sum(w for k, w in weights.items() if k[i] < 0)
        assert abs(got[i] - np.log(up / down) / 2) < 1e-3


def test_redaction_keeps_the_rest(trained):
    text = "é 日本 Call me on (415) 555-0183, twice.\r\n\ttel. (415) 555-0183"
    spans = pii.decode([text], *trained)[0]
    assert pii.redact(text, spans) == "é 日本 Call me on [PHONE], twice.\r\n\ttel. [PHONE]"


def test_frames(spark, trained):
    rows = [("A", 2, "tel. (415) 555-0183"), ("a", 1, "old mail x@example.org"), ("b", 1, None), ("c", 1, " "), (None, 1, "tel. (415) 555-0184"), ("d", 1, "mail y@example.org and y@example.org"), ("d", 1, "mail y@example.org and y@example.org"), ("e", 1, "word " * 60_000 + "mail z@example.org")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "id string, updated_at int, content string, pii_type string, nth int")
    now = pii.current_contents([("t", df, "updated_at")])
    assert now.count() == 4
    got = {(r.record_id, r.pii_type, r.nth) for r in pii.find_pii(now, *trained).where("pii_type != 'NAME'").collect()}
    assert got == {("a", "PHONE", 1), ("d", "EMAIL", 1), ("d", "EMAIL", 2), ("e", "EMAIL", 1)}
    assert pii.find_pii(now.limit(0), *trained).count() == 0
    names = spark.createDataFrame([], "name_part string, part_kind string")
    assert pii.train([("t", df.limit(0), "updated_at")], names)[0].lexicon == set()


def test_words_are_counted_over_all_contents(spark):
    rows = [(f"r{i}", 1, "Then Zorbel met the crew. " * 3 if i % 3 == 0 else "Nobody was there.") for i in range(300)]
    rows += [(f"r{i}", 0, "Oldword was said.") for i in range(100)] + [("long", 1, "word " * 6_000 + "Endword")]
    df = spark.createDataFrame(rows, "id string, updated_at int, content string")
    tables, names = [("t", df, "updated_at")], spark.createDataFrame([("Mara", "given")], "name_part string, part_kind string")
    finder, _ = pii.train(tables, names, train_texts=10_000)
    assert finder.counts["Zorbel"] == 100 and "Oldword" not in finder.counts and finder.counts["Endword"] == 1
    assert "Zorbel" in finder.common
    small, _ = pii.train(tables, names, train_texts=30)  # the share of texts counts, not which are in the sample
    assert small.counts["Zorbel"] == 10 and small.counts["Nobody"] == 20 and "Zorbel" not in small.common


def test_reserved_ranges_and_fences_are_none(trained):
    texts = ["Range 200-300-1470 is reserved for lookups.", "```python\n@app.tool\ndef f(): ...\n```\nnobody saw the stale copy."]
    assert pii.decode(texts, *trained) == [[], []]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail rook@mail.example.org now", "rook@mail.example.org"),
        ("rook [at] post [dot] example [dot] org", "rook [at] post [dot] example [dot] org"),
        ("(mobile: +44 (0)7700 900 351)", "+44 (0)7700 900 351"),
        ("Flat 5, 67 Millrace Blvd, Ostermere Bay VX7 9QT. Next", "Flat 5, 67 Millrace Blvd, Ostermere Bay VX7 9QT"),
        ("450 Quarrel Close\nVelmouth\nVX0 7QT", "450 Quarrel Close\nVelmouth\nVX0 7QT"),
        ("Krummweg 73a\nMinutes were taken", "Krummweg 73a"),
        ("passport no. X01239465\nA line", "X01239465"),
    ],
)
def test_spans_are_whole(text, found):
    assert [text[c.start : c.end] for c in pii.Finder(*KNOWN).structured(text)] == [found]


def test_a_common_word_stays_a_candidate_with_its_odds():
    finder = pii.Finder(*KNOWN, common={"Monday": -5.0})
    assert [(c.word, c.prior) for c in finder.find("signed by Monday") if c.kind == "NAME"] == [("monday", -5.0)]


def test_places_teach_patterns_that_do_not_say_what_they_are():
    finder = pii.Finder([], [])
    texts = [f"Range 200-300-{i} is" for i in range(1000, 1012)] + [f"ring 212-555-{i} now" for i in range(1000, 1008)] + [f"ring +44 20 7946 0{i} now" for i in range(100, 116)]
    cands = [c for t in texts for c in finder.find(t) if c.kind == "PHONE"]
    places = pii._Places(cands)
    assert [places.label(c) for c in cands] == [-1] * 12 + [1] * 24
