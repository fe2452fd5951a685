import random

import numpy as np

from voltmill.llm.mojibake import SKETCH_BITS, UNICODE, PairStatistics, Repairer, _codes, _slots, find_garbled, inverse, maximal_segments

CLEAN = {
    "de": "Die Kupferfläche zerfällt in Inseln, größer als nötig – Maß über 5 µm für Ströme. ",
    "fr": "Le réseau relié à la masse est très chargé, vérifiez l’épaisseur de la couche éloignée. ",
    "ru": "Плотность тока в проводнике выше нормы, проверьте переходные отверстия и полигон. ",
    "zh": "该区域的功率密度偏高,可能是热焊盘太窄。网格共有顶点和三角形,求解用了迭代。",
    "ja": "電源ネットの電圧降下は許容範囲です。銅箔の厚さを確認してください。",
    "en": "The via drops 5 °C at 3 Ω; it’s “fine” — no change needed. ",
}


def corpus():
    rnd = random.Random(8)
    rows = []
    for i in range(1500):
        lang = rnd.choice(list(CLEAN))
        rows.append((i, CLEAN[lang] * rnd.randrange(1, 4) + f"R{rnd.randrange(999)}", lang))
    bad = {}
    cases = [("utf-8", "cp1252", "de"), ("utf-8", "latin-1", "ru"), ("utf-8", "cp1251", "zh"), ("cp1251", "koi8-r", "ru"), ("gbk", "latin-1", "zh"), ("utf-8", "mac_roman", "fr"), ("utf-8", "cp437", "en")]
    for k, (true, wrong, lang) in enumerate(cases):
        text = CLEAN[lang]
        garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(true, "ignore"))
        rows.append((2000 + k, "All in order here. " + garbled, lang))
        bad[2000 + k] = "All in order here. " + text.encode(true, "ignore").decode(true)
    rows += [(3000, None, None), (3001, "", "en"), (3002, "   ", "en"), (3003, "Pr�s de Q19", "fr"), (3004, "├── src\n└── doc", "en"), (3005, CLEAN["zh"] * 400, "zh")]
    return rows, bad


def test_finds_and_restores(spark):
    rows, bad = corpus()
    frame = spark.createDataFrame([(*r, "gain of the row") for r in rows] + [(2000, rows[1500][1], "de", "again")], "doc_id long, text string, lang string, gain string")
    found = find_garbled(frame, "text").collect()
    assert {r.doc_id for r in found} == set(bad) | {3003}
    assert sum(r.doc_id == 2000 for r in found) == 2
    for r in found:
        if r.doc_id in bad:
            assert r.restored == bad[r.doc_id], (r.mappings, r.restored)
        else:
            assert r.mappings == "lost" and r.restored is None


def test_letters_that_became_symbols(spark):
    """Passages whose only traces are symbols: box drawing, signs of division, superscripts."""
    rows, _ = corpus()
    rows = [r for r in rows if r[0] < 2000]
    clean = {"ru": "плотность тока в проводнике выше нормы", "de": "Maß über größer", "fr": "à la masse, à côté de là"}
    cases = [("koi8-r", "cp866", "ru"), ("cp1252", "cp850", "de"), ("cp1252", "mac_roman", "fr")]
    rows += [(2000 + k, clean[lang] + f" R{k}", lang) for k, lang in enumerate([*clean] * 60)]
    garbled = {3000 + k: (clean[lang], clean[lang].encode(true).decode(wrong)) for k, (true, wrong, lang) in enumerate(cases)}
    assert not any(c.isalpha() for c in garbled[3000][1])
    rows += [(k, text, None) for k, (_, text) in garbled.items()]
    rows += [(4000, "It was safer. … Current of the pour … Revision … and … so on – “or” •", "en")]
    found = {r.doc_id: r for r in find_garbled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text").collect()}
    assert {k: r.mappings for k, r in found.items()} == {3000 + k: f"{wrong}/{true}" for k, (true, wrong, _) in enumerate(cases)}
    assert found[3001].restored == garbled[3001][0]


def test_garbled_beside_sound_text(spark):
    """UTF-8 read as GBK with sound Chinese before and after it, nothing between them."""
    rows, _ = corpus()
    rows = [r for r in rows if r[0] < 2000]
    sound, other = "该区域的", "功率密度"
    rows.append((2000, "See: " + sound + other.encode().decode("gbk") + "偏高.", "zh"))
    found = find_garbled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text").collect()
    assert [(r.doc_id, r.mappings, r.restored) for r in found] == [(2000, "gbk/utf-8", "See: " + sound + other + "偏高.")]


def statistics_of(texts):
    codes = _codes("\n" + "\n".join(texts) + "\n")
    pairs, n = np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)
    base = 2 << SKETCH_BITS
    cells = np.zeros(base + 2 * UNICODE, np.float32)
    for at in (*_slots(pairs), base + (pairs >> 21), base + UNICODE + (pairs & (1 << 21) - 1)):
        np.add.at(cells, at, n)
    return PairStatistics(cells[:base], cells[base : base + UNICODE], cells[base + UNICODE :])


def test_what_lies_outside_improbable_runs_stays():
    """A sequence that the corpus has everywhere is no improbable run and is not undone beside one that is."""
    own = "der Code Ã¤ gilt, "
    repairer = Repairer(statistics_of([own * 5 + CLEAN["de"]] * 400))
    text = own + CLEAN["de"].encode().decode("latin-1") + own
    runs = (repairer.improbable(_codes("\n" + text + "\n")) - 1).tolist()
    mappings, restored, _ = repairer.repair(text, runs)
    assert mappings == "latin-1/utf-8" and restored == own + CLEAN["de"] + own


def test_garbled_beside_sound_accents():
    """UTF-8 read in single bytes with a sound accented letter right before it."""
    repairer = Repairer(statistics_of([t for t in CLEAN.values() for _ in range(300)]))
    text = "Maß über ä" + "größer".encode().decode("latin-1")[2:] + " für Ströme"
    runs = (repairer.improbable(_codes("\n" + text + "\n")) - 1).tolist()
    assert repairer.repair(text, runs)[1] == "Maß über äößer für Ströme"


def test_segments_are_those_of_all_pairs():
    """Segments and touched stretches against maximal_segments over each cluster of scored pairs."""
    rnd = random.Random(3)
    repairer = Repairer(statistics_of([t for t in CLEAN.values() for _ in range(20)]))
    for _ in range(60):
        text = "".join(rnd.choice("aü é漢字Ñ\nж ") for _ in range(rnd.randrange(0, 40)))
        codes = _codes("\n" + text + "\n")
        want, at = [], 0
        while at < len(codes) - 1:
            stop = at
            while stop < len(codes) - 1 and (codes[stop] >= 128 or codes[stop + 1] >= 128) and (stop == at or codes[stop] != 10):
                stop += 1
            if stop > at:
                scores = repairer.statistics.scores_at(codes, np.arange(at, stop))
                want += [(at + a, at + b + 1) for a, b in maximal_segments((-16.0 - scores).tolist())]
            at = max(stop, at + 1)
        assert repairer.segments(codes, -16.0).tolist() == [list(w) for w in want]
        touched = {i for a, b in want for i in range(a, b) if codes[i] >= 128}
        runs = repairer.improbable(codes).tolist()
        assert all(touched & set(range(a, b)) for a, b in runs) and touched <= {i for a, b in runs for i in range(a, b)}


def test_empty_table(spark):
    assert find_garbled(spark.createDataFrame([], "doc_id long, text string"), "text").collect() == []


def test_inverse():
    assert inverse("Ã©", "cp1252", "utf-8") == "é"
    assert inverse("é", "cp1252", "utf-8") is None
    assert inverse("абв", "latin-1", "utf-8") is None


def test_maximal_segments():
    rnd = random.Random(9)
    assert maximal_segments([]) == [] and maximal_segments([-1.0, 0.0]) == []
    assert maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]
    for _ in range(300):
        scores = [rnd.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rnd.randrange(1, 14))]
        found = maximal_segments(scores)
        best = max(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
        assert (max(sum(scores[a:b]) for a, b in found) if found else 0) == max(best, 0)
        assert all(sum(scores[a:b]) > 0 for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
