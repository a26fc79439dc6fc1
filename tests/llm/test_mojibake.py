import random

import pytest

from tallyforge.llm import mojibake as B

SOUND = {
    "fr": "L’équipe a déjà vérifié le contrôle où l’accès était refusé ; voilà pourquoi la réécriture coûtera cher. Le cœur du problème n’est pas là",
    "de": "Die größeren Lücken schließen wir zuerst, weil die Prüfung ungewöhnlich lange läuft und über Änderungen hört man nichts. Übrig bleibt „nichts“",
    "es": "La revisión señaló más desviaciones; sólo la duplicación pedía atención según el límite. ¿Por qué el año pasado no? Ningún fallo después",
    "pl": "Przegląd wskazał odchyleń więcej niż zwykle, ale większe luki usunąć należy wcześniej, ponieważ układ pól zależy od słabej reguły",
    "ru": "Мы оставили переписывать план дольше чем нужно, потому что критерий ещё не закрыт и проверка слаба",
    "en": "The reader’s cache holds “many” entries — older ones are dropped… so we don’t promote ≥ 3 rules → ever, ± one, and `code` ✓ passes",
}


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUND))
        words = SOUND[lang].split()
        rows.append((i, lang, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))))
    return rows


@pytest.fixture(scope="module")
def model():
    counts = {}
    for _, _, t in corpus(2000, seed=9):
        for k in {k for _, _, k in B.words(t)}:
            counts[k] = counts.get(k, 0) + 1
    return B.train(counts, 2000)


CHAINS = [
    (("utf_8", "cp1252"),), (("utf_8", "latin_1"),), (("utf_8", "cp1251"),), (("utf_8", "cp850"),), (("utf_8", "mac_roman"),),
    (("utf_8", "cp1252"), ("utf_8", "cp1252")), (("cp1252", "cp850"),), (("mac_roman", "cp1252"),), (("cp1251", "cp1252"),), (("koi8_r", "cp1251"),),
]


def test_chains_invert():
    codec = B.Codec()
    for chain in B.chains():
        for text in SOUND.values():
            g = codec.garble(text, chain)
            if g is not None:
                assert codec.restore(g, chain) == text


def test_held_out_accuracy(model):
    codec, reader = B.Codec(), B.Reader(model)
    rng = random.Random(3)
    right = restored = cases = false = sound = 0
    for _, _, text in corpus(700, seed=77):
        g = text
        if rng.random() < 0.5:
            a = rng.randrange(len(text))
            made = codec.garble(text[a:], rng.choice(CHAINS))  # garbled from somewhere on
            g = text if made is None else text[:a] + made
        found = list(B.words(g))
        reader.learn(k for _, _, k in found)
        got = reader.read(g, found)
        if g != text:
            cases += 1
            right += got is not None
            restored += got is not None and got[3] == text
        else:
            sound += 1
            false += got is not None
    assert cases > 200
    assert right / cases >= 0.95
    assert restored / cases >= 0.75
    assert false / sound <= 0.01


#: Sentences without a word beyond ASCII that the training sentences have.
OTHER = {
    "fr": "La fenêtre s’ouvre après minuit, même si le gérant préfère fermer tôt ; l’élève français a reçu une leçon sévère à la forêt",
    "de": "Der König mag schöne Lieder, während draußen Vögel fröhlich um müde Gärtner fliegen und süße Äpfel fallen „leise“",
    "es": "El niño comió un plátano mientras la compañía añadía café; ¿Cuántos años cumplió el capitán? Mañana llegará algún pájaro rápido",
    "pl": "Chłopiec jeździ łódką po jeziorze, gdzie pływają żółte kaczki, a źrebię śpi pod dębem koło ścieżki i czuje ciepło słońca",
    "ru": "Зимой дети катаются с горки на санках возле реки, пока бабушка печёт вкусные пироги дома и читает старую книгу",
    "en": "She’s never seen the “northern” lights — they’re brighter… than we’d thought",
}


def test_words_not_seen_in_training(model):
    """Accuracy on texts none of whose words beyond ASCII the model was trained on, garbled from a random word on."""
    seen = {k for t in SOUND.values() for _, _, k in B.words(t) if k.isalpha()}
    assert not seen & {k for t in OTHER.values() for _, _, k in B.words(t) if len(k) > 1 and k.isalpha()}
    codec, reader, rng = B.Codec(), B.Reader(model), random.Random(11)
    right = cases = false = sound = 0
    for _ in range(600):
        w = rng.choice(list(OTHER.values())).split()
        text = " ".join(rng.choice(w) for _ in range(rng.randint(8, 40)))
        g = text
        if rng.random() < 0.5:
            a = rng.randrange(len(text) // 2)
            g = text[:a] + (codec.garble(text[a:], rng.choice(CHAINS)) or text[a:])
        found = list(B.words(g))
        reader.learn(k for _, _, k in found)
        hit = reader.read(g, found) is not None
        cases, right = cases + (g != text), right + (g != text and hit)
        sound, false = sound + (g == text), false + (g == text and hit)
    print(f"found {right} of {cases}, false {false} of {sound}")
    assert right / cases >= HELD_OUT_FOUND
    assert false / sound <= HELD_OUT_FALSE


#: What six training sentences are enough for.
HELD_OUT_FOUND, HELD_OUT_FALSE = 0.9, 0.1


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, _, t in rows], "doc_id bigint, text string, chain string, restored string")
    return {r["doc_id"]: r for r in B.garbled(df, "doc_id", "text").collect()}


def test_table(spark):
    rows = corpus()
    bad = "Die PrÃ¼fung lÃ¤uft Ã¼ber grÃ¶ÃŸere LÃ¼cken"
    rows += [(1000, "de", bad), (1001, "de", bad), (1002, None, None), (1003, "en", ""), (1004, "en", "plain ascii only"), (1005, "fr", "Le contrôle est coup�"), (1006, "es", "la comprobaci�n qued� cubierta")]
    rows += [(1007, "de", "\n".join([SOUND["de"]] * 500 + [bad]))]
    got = run(spark, rows)
    assert set(got) == {1000, 1001, 1006, 1007}
    assert got[1000]["restored"] == "Die Prüfung läuft über größere Lücken"
    assert got[1000]["chain"] == "utf_8>cp1252"
    assert got[1006]["chain"] == "lost"
    assert got[1007]["restored"].endswith("größere Lücken")


def test_references(spark):
    rows = corpus()
    bad = "Die Pr&Atilde;&frac14;fung l&Atilde;&curren;uft &Atilde;&frac14;ber 3 &lt; 4"
    rows += [(1000, "de", bad), (1001, "fr", "Le contr&ocirc;le est d&eacute;j&agrave; l&agrave; &amp; &#233;crit"), (1002, "en", "a &nosuch; b &"), (1003, "de", "Größer &Atilde;&frac14;ber")]
    got = run(spark, rows)
    assert set(got) == {1000, 1003}
    assert got[1000]["restored"] == "Die Prüfung läuft über 3 &lt; 4"
    assert got[1000]["chain"] == "utf_8>cp1252>html"
    assert B.dereferenced("&amp;&lt;&#65;&eacute;") == "&amp;&lt;&#65;é"


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None, None), (2, None, "abc")]) == {}


def test_cut_marks():
    assert not B.is_lost("cut off�")
    assert not B.is_lost("cut off� \n")
    assert B.is_lost("two��")
    assert B.is_lost("qued� cubierta")


def test_copies_of_one_garbled_text_are_not_learnt_as_sound(spark):
    rows = corpus(600)
    bad = B.Codec().garble(SOUND["ru"], (("cp1251", "koi8_r"),))
    rows += [(1000 + i, "ru", bad) for i in range(300)]
    assert set(run(spark, rows)) == {1000 + i for i in range(300)}
