import random

import pytest

from weftline.llm import garbled as g

CLEAN = {
    "fr": "Les notes sur les étiquettes complètent la réponse à moitié. « Oui » dit-elle, où l’été dépasse la forêt. Ça a été relancé très tôt. ",
    "de": "Größere Blöcke über Lagerschilder für Süßwaren benötigen Zeit. Der Schlüssel schlägt häufig fehl – ähnlich wie früher. ",
    "es": "El año pasado se añadieron notas sobre la reparación. ¿Por qué respondió rápidamente? La función quedó vacía, así que falló. ",
    "pl": "Dzień pierwszy: usługa została usunięta. Średni czas, choć bywał dłuższy. Odpowiedź wróciła późno, już połowa notatek. ",
    "ru": "Среднее время меньше прежнего. Сводка содержит лишние поля. Агент ответил на вопросы про обрезку яблонь, ссылка прервана. ",
    "en": "It’s the café list for printer queues: “quiet” at 20 °C — naïve readers don’t mind the façade. Nothing else happened today. ",
}
SWAPS = [("fr", "utf-8", "cp1252"), ("de", "utf-8", "latin-1"), ("es", "utf-8", "cp437"), ("pl", "utf-8", "cp1250"), ("ru", "koi8_r", "cp1251"), ("ru", "cp1251", "cp1252"), ("es", "mac_roman", "cp1252"), ("de", "cp850", "cp1252"), ("pl", "cp1250", "cp1252"), ("en", "utf-8", "mac_roman"), ("fr", "utf-8", "cp850")]
DECOYS = ["Phở, bún chả and bánh mì are on the menu.", "If you see `Ã©` or `â€™` in a chunk, report it.", "The card shows “½ × ¼ ≈ ⅛”, 20 °C ± 2, § 4 ¶ 2, © and ®.", "ATENÇÃO: NÃO HÁ INFORMAÇÕES SOBRE A SESSÃO", "Escapes such as \\u00e9, %C3%A9 and &eacute; are stored.", "Ещё раз: СССР и Ёлка — обычные слова.", "Café and naïve use combining marks here."]


def _docs():
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        lang = rnd.choice(list(CLEAN))
        rows.append((i, f"s{i % 3}", " ".join(rnd.sample(CLEAN[lang].split(". "), 2)) + "\n" + CLEAN[rnd.choice(["en", lang])] * rnd.randint(1, 3), False, None))
    for k in range(220):
        lang, true, wrong = SWAPS[k % len(SWAPS)]
        text = CLEAN[lang]
        bad = text.encode(true, "ignore").decode(wrong, "ignore" if wrong != "cp1252" else "replace").replace("�", "")
        rows.append((10_000 + k, f"s{k % 3}", "Plain words first.\n" + bad, True, "Plain words first.\n" + text))
    for k, t in enumerate(DECOYS * 3):
        rows.append((20_000 + k, "s1", "Plain words first. " + t, False, None))
    rows += [(30_000, "s1", None, False, None), (30_001, None, "", False, None), (30_002, None, "agent�s turn", True, None), (30_003, "s2", "x" * 200_000, False, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(r[0], r[1], r[2], "clash") for r in _docs()], "doc_id long, source string, text string, swap string").cache()


def test_found_and_restored(spark, docs):
    truth = {r[0]: r for r in _docs()}
    lm = g.language_of(docs)
    bad = g.garbled_documents(docs, lm).cache()
    found = {r.doc_id for r in bad.collect()}
    want = {i for i, r in truth.items() if r[3]}
    assert len(found & want) / len(want) > 0.97
    assert len(found - want) <= 2
    texts = docs.select("doc_id", "text").join(bad, "doc_id")
    ciphers = g.learn_ciphers(g.cipher_statistics(texts, lm), lm)
    back = {r.doc_id: r.restored for r in g.restore(texts, lm, ciphers).collect()}
    whole = {r.doc_id: r.restored for r in g.restored_documents(docs).collect()}
    assert whole == back
    good = sum(back[i] == truth[i][4] for i in found & want if truth[i][4])
    assert good / sum(1 for i in found & want if truth[i][4]) > 0.6


def test_empty_table(docs):
    assert g.garbled_documents(docs.limit(0)).count() == 0


def test_tables_follow_from_code_pages():
    assert g.decipher("Ã©", "cp1252", "utf_8") == "é"
    assert g.decipher("ñ", "cp1252", "cp1250") == "ń"
    assert g.decipher("日", "cp1252", "utf_8") is None
    assert g.unquoted("a `Ã©` b") == "a      b"


def test_em_learns_a_letter_from_its_neighbours(spark, docs):
    lm = g.language_of(docs)
    rows = [("s", 3, "¤", "ß", a, b, 40) for a, b in (("r", "p"), ("a", "s"), ("t", "i"), ("c", "p"))]
    out = g.learn_ciphers(spark.createDataFrame(rows, g.UNITS), lm, faith=0.5).collect()
    assert len(out) == 1 and out[0].symbol == "¤" and out[0].letter != "" and 0 < out[0].share <= 1


def test_unlisted_swap_is_learned_from_nothing(spark):
    """cp1252 read as cp1253 is no pair of the list."""
    assert "cp1253" not in {x for s in g.SWAPS for x in s}
    rnd, bits = random.Random(7), [x for t in ("fr", "de", "es") for x in CLEAN[t].replace("«", "").replace("»", "").replace("’", "'").replace("–", "-").split(". ") if x.strip()]
    words = sorted({w for x in bits for w in x.split()})
    rows = [(i, "s1" if i % 2 else "s2", " ".join(rnd.sample(words, 30))) for i in range(1200)]
    bad = {i: " ".join(rnd.sample(words, 30)) for i in range(5000, 5060)}
    rows += [(i, "s1", t.encode("cp1252").decode("cp1253", "ignore")) for i, t in bad.items()]
    rows += [(9000 + i, "s2", "plain words and Ελλάδα, Αθήνα or θ = 3") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    lm = g.language_of(docs)
    found, ciphers = g.garbled_with_ciphers(docs, lm)
    found = found.cache()
    ids = {r.doc_id for r in found.collect()}
    assert len(ids & set(bad)) >= 57 and len(ids - set(bad)) <= 1
    learned = {r.symbol: r.letter for r in ciphers.collect() if r.source == "s1"}
    assert learned["ι"] == "é" and all(ord(c) < 128 or s.encode("cp1253").decode("cp1252") == c for s, c in learned.items())
    back = {r.doc_id: r.restored for r in g.restore(docs.select("doc_id", "text").join(found, "doc_id"), lm, ciphers).collect()}
    assert sum("é" in back[i] for i in ids & set(bad) if "é" in bad[i]) > 50


def test_swap_far_down_by_gain_wins_by_its_weight(spark):
    """Of the many swaps that read a passage well, the one its source is garbled by wins, wherever it ranks by gain."""
    lm = g.Language(dict(g._pairs([t for t in CLEAN.values() for _ in range(200)])))
    swap = g.SWAPS.index(("cp1250", "cp850"))
    found = g.Decoder(lm).scan("Plain words. " + "rápidamente?".encode("cp850").decode("cp1250") + " and so on.")[1]
    assert [k for k, *_ in found].index(swap) >= 8
    row = lambda i, f: (i, "s", False, [x[0] for x in f], [x[1] for x in f], [])
    rows = [row(i, [(swap, 30.0, 0, 1)]) for i in range(400)] + [row(999, found)]
    out = g.decide(spark.createDataFrame(rows, g.SCAN), spark.createDataFrame([("s", 401)], "source string, n_docs long"))
    assert {r.doc_id: r.swap for r in out.collect()}[999] == swap


@pytest.mark.parametrize(("kind", "share"), [("cp1252 as cp1253", 0.8), ("utf_8 as cp1253", 0.7), ("permutation", 0.8)])
def test_unknown_swaps_are_learned_and_undone(kind, share):
    rnd = random.Random(11)
    words = sorted({w for t in ("fr", "de", "es") for w in CLEAN[t].replace(". ", " ").split() if w.isalpha()})
    lm = g.Language(dict(g._pairs([" ".join(rnd.sample(words, 40)) for _ in range(600)])))
    letters = g._letters(lm)
    perm = dict(zip(map(ord, letters), rnd.sample([chr(c) for c in [*range(0x531, 0x557), *range(0x10D0, 0x10F0)]], len(letters)), strict=True))
    garble = {"cp1252 as cp1253": lambda t: t.encode("cp1252").decode("cp1253", "ignore"), "utf_8 as cp1253": lambda t: t.encode().decode("cp1253", "ignore"), "permutation": lambda t: t.translate(perm)}[kind]
    texts = [" ".join(rnd.sample(words, 40)) for _ in range(60)]
    odds = [g.Decoder(lm).scan(garble(t))[2] for t in texts]
    counts = g.Counter(u for odd in odds for u in g.odd_units(odd, lm))
    table = g.learn_unlisted(g.pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["symbol", "before", "after", "n"]), lm, letters)
    cipher = {s: c for s, c, _ in table}
    assert sum(g.unlisted_gain(odd, cipher, lm) > 12 for odd in odds) >= 0.9 * len(texts)
    want = g.Counter(c for t in texts for c in t if c > "\x7f")
    back = g.Counter(c for t in texts for c in g.decipher_with(garble(t), cipher) if c > "\x7f")
    assert sum((want & back).values()) >= share * sum(want.values())
