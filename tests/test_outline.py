"""The windowed fold against a plain state machine on random block streams."""

import random
import re

from lexmill.operators import outline

LEVEL = {"LETTER": 1, "ROMAN": 2, "DIGIT": 3, "LOWER": 4, "LOWER2": 5}
ORD = r"(?:BİRİNCİ|İKİNCİ|SON)"
STRUCT = re.compile(rf"^({ORD}\s+(KİTAP|KISIM|BÖLÜM|AYIRIM|AYRIM|FASIL))\b")
ARTICLE = re.compile(r"^(GEÇİCİ MADDE|EK MADDE|MADDE)\s+(\d+)\s*(?:/\s*(\w))?\s*[-–—]?\s*")
HEAD = re.compile(r"^([A-Z]|[IVXLCDM]{1,5}|\d{1,2}|[a-z]{1,3})\s*[.)]\s+(\S.*)$")


def machine(blocks):
    levels, path, out, cur, waiting, note, n = {}, {}, [], None, None, "", 0

    def put(level, value):
        level = {"AYRIM": "AYIRIM", "FASIL": "BÖLÜM"}.get(level, level)
        names = list(outline.LEVELS)
        for x in names[names.index(level) :]:
            levels[x] = ""
        levels[level] = value

    def close():
        nonlocal cur
        if cur and cur["paragraphs"]:
            out.append(cur)
        cur = None

    for text, heading in blocks:
        if outline.TABLE_START in text or re.match(r"^\s*\[\d+\]\s", text):
            break
        if outline.OUTSIDE_START in text:
            close()
            path, note = {}, outline.OUTSIDE_NOTE
            continue
        if waiting:
            level, label = waiting
            waiting = None
            named = not (ARTICLE.match(text) or STRUCT.match(text))
            put(level, f"{label} {text}" if named else label)
            path = {}
            if named:
                continue
        if m := STRUCT.match(text):
            close()
            path = {}
            rest = text[m.end() :].strip(" -–—")
            if rest:
                put(m[2], f"{m[1]} {rest}")
            else:
                waiting = (m[2], m[1])
        elif m := ARTICLE.match(text):
            close()
            n += 1
            number = m[2] + (f"/{m[3].upper()}" if m[3] else "")
            kind = {"G": "gecici", "E": "ek", "M": "madde"}[m[1][0]]
            number = {"gecici": "GEÇİCİ ", "ek": "EK ", "madde": ""}[kind] + number
            cur = {"no": number, "kind": kind, "heading": path[max(path)] if path else "", "topic": " > ".join(path[k] for k in sorted(path)), "levels": tuple(levels.get(x, "") for x in outline.LEVELS), "note": note, "ordinal": n, "paragraphs": []}
            if rest := text[m.end() :].strip():
                cur["paragraphs"].append(rest)
        elif heading:
            if m := HEAD.match(text):
                k = m[1]
                roman = k in "I II III IV VI VII VIII IX XI XII".split()
                level = 3 if k.isdigit() else (5 if len(k) > 1 else 4) if k.islower() else 2 if roman else 1
                path = {a: b for a, b in path.items() if a < level} | {level: text}
            else:
                path = {1: text}
        elif cur is not None:
            cur["paragraphs"].append(text)
    close()
    return out


def stream(rng, n=40):
    kinds = [
        lambda: (f"{rng.choice(['BİRİNCİ', 'İKİNCİ', 'SON'])} {rng.choice(['KİTAP', 'KISIM', 'BÖLÜM', 'AYIRIM', 'AYRIM', 'FASIL'])}{rng.choice(['', ' - Adı'])}", True),
        lambda: (f"{rng.choice(['MADDE', 'MADDE', 'MADDE', 'EK MADDE', 'GEÇİCİ MADDE'])} {rng.randint(1, 99)}{rng.choice(['', '/a'])}- {rng.choice(['', 'metin'])}", rng.random() < 0.2),
        lambda: (f"{rng.choice(['A', 'V', 'I', 'II', 'IX', '1', '12', 'a', 'aa'])}. Başlık {rng.randint(0, 9)}", True),
        lambda: ("Yürürlük", True),
        lambda: (f"Fıkra {rng.randint(0, 999)}", False),
        lambda: ("6098 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER", True),
        lambda: rng.choice([("[1] dipnot", False), ("X SAYILI KANUNA EK VE DEĞİŞİKLİK GETİREN", True)]),
    ]
    return [rng.choices(kinds, [4, 8, 8, 1, 12, 0.6, 0.15])[0]() for _ in range(n)]


def test_fold_equals_state_machine(spark):
    rng = random.Random(4)
    docs = [stream(rng) for _ in range(250)]
    rows = [(d, p, t, t, h) for d, blocks in enumerate(docs) for p, (t, h) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "source_id long, pos int, text string, text_raw string, is_heading boolean")
    got = {(r.source_id, r.ordinal): r for r in outline.articles(df).collect()}
    want = {(d, a["ordinal"]): a for d, blocks in enumerate(docs) for a in machine(blocks)}
    assert got.keys() == want.keys() and len(want) > 1000
    for k, a in want.items():
        r = got[k]
        assert (r.article_no, r.kind, r.heading, r.topic, (r.book, r.part, r.chapter, r.section), r.note, r.paragraphs) == (a["no"], a["kind"], a["heading"], a["topic"], a["levels"], a["note"], a["paragraphs"]), (k, docs[k[0]])


def test_header(spark):
    rows = [(1, 0, "Kanun Numarası : 6098 Kabul Tarihi : 11/1/2011"), (1, 1, "Resmî Gazete : Tarih : 4/2/2011 Sayı : 27836"), (1, 50, "x"), (2, 0, "nothing")]
    got = {r.source_id: (r.accepted, r.gazette) for r in outline.header_meta(spark.createDataFrame(rows, "source_id long, pos int, text string")).collect()}
    assert got == {1: ("11/1/2011", "4/2/2011 tarihli, 27836 sayılı Resmî Gazete"), 2: ("", "")}


def test_no_blocks(spark):
    df = spark.createDataFrame([], "source_id long, pos int, text string, text_raw string, is_heading boolean")
    assert outline.articles(df).count() == 0
