import html
import re

import pytest

from parlatrace.llm import pii
from parlatrace.llm.pii_rules import Plain, mentions


def found(text):
    return [(m.kind, m.value, m.start) for m in mentions(text)]


CASES = [
    ("Just mail ann.lee+x@some-host.co.test and ask.", [("email", "ann.lee+x@some-host.co.test")]),
    ("Send it to ann dot lee at some-host dot example please.", [("email", "ann dot lee at some-host dot example")]),
    ("use ann_lee (at) host (dot) org (dot) test instead", [("email", "ann_lee (at) host (dot) org (dot) test")]),
    ("Escriba a j underscore varn at host dot test, por favor", [("email", "j underscore varn at host dot test")]),
    ("The shelf. At five dot two percent, it is within the limit.", []),
    ("Call me on (386) 555-0164 after six.", [("phone", "(386) 555-0164")]),
    ("+44 (0)7700 900411, I think.", [("phone", "+44 (0)7700 900411")]),
    ("Die Nummer lautet 0049 (30) 23125784, aber nur vormittags.", [("phone", "0049 (30) 23125784")]),
    ("Rufen Sie mich unter 030/23125-617 an.", [("phone", "030/23125-617")]),
    ("If it is urgent, seven six one, five five five, oh one three two is the direct line.", [("phone", "seven six one, five five five, oh one three two")]),
    ("For the record, my tax number is L9T99863X9.", [("id_number", "L9T99863X9")]),
    ("They wanted my ID, so I read out QQ 58 61 50 C to them.", [("id_number", "QQ 58 61 50 C")]),
    ("Meine Steuernummer ist 45 796 018 838.", [("id_number", "45 796 018 838")]),
    ("The passport number is nine eight seven six five four three two one.", [("id_number", "nine eight seven six five four three two one")]),
    ("The invoice ends in 4471-220 and covers it. Ticket QX-2204-118, version 10.2.14, room 14 at 10:30, 5550 units.", []),
    ("I am at Flat 10, 183 Marrow Yard now, second bell.", [("address", "Flat 10, 183 Marrow Yard")]),
    ("Please deliver it to 73 Tallow Terrace, apartment 40.", [("address", "73 Tallow Terrace, apartment 40")]),
    ("six Harrow Hill, that is where we met.", [("address", "six Harrow Hill")]),
    ("Bitte liefern Sie alles an Große Binsenallee 37 c.", [("address", "Große Binsenallee 37 c")]),
    ("Wir wohnen in der Nähe, Am Alten Werk 115b.", [("address", "Am Alten Werk 115b")]),
    ("Vivimos en Calle del Brezo número 166 desde hace años.", [("address", "Calle del Brezo número 166")]),
    ("Gate 3 opens on the long road in the annex. They parked outside Orlin station by the Tolle bridge.", []),
    ("Interview with Ann-Mae O'Lee", [("name", "Ann-Mae O'Lee")]),
    ("Doctor Ann Lee signed the sheet. My neighbour M. Torr saw it.", [("name", "Ann Lee"), ("name", "M. Torr")]),
    ("It was Ray-Bell's idea to move the shelf.", [("name", "Ray-Bell")]),
    ("Ann Lee and Torr were both on leave.", [("name", "Ann Lee"), ("name", "Torr")]),
    ("We had Ann in the room, and later Torr Lee.", [("name", "Ann"), ("name", "Torr Lee")]),
    ("Frau Ann Lee hat das unterschrieben. Ich habe Torr danach gefragt.", [("name", "Ann Lee"), ("name", "Torr")]),
    ("La señora Lee firmó la hoja. Le pregunté a Ann Torr y dijo que no.", [("name", "Lee"), ("name", "Ann Torr")]),
    ("That was the reason. Thanks, everyone. I asked them about it. Later the team took over the shift.", []),
    ("we ordered it from the brack catalogue please mark the date down in the dale", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_rules(text, want):
    got = found(text)
    assert [(k, v) for k, v, _ in got] == want
    for _, value, start in got:
        assert text[start : start + len(value)] == value


def test_positions_in_html():
    source = '<style>a@b.test</style><p>Interview with Ann <wbr>Le<b></b>e</p><p><a name="x">mail ann&#64;ho<!-- cut -->st.test uh, or call +1 uh, 311 555 01&#8203;46.</a></p>'
    got = found(source)
    assert [(k, v) for k, v, _ in got] == [("name", "Ann Lee"), ("email", "ann@host.test"), ("phone", "+1 311 555 0146")]
    assert [source[p : p + 3] for _, _, p in got] == ["Ann", "ann", "+1 "]
    plain = Plain(source)
    assert all(html.unescape(source[plain.place(i) :][:8])[0] in (c, "<", "\xa0") for i, c in enumerate(plain.text) if c.isalnum())


def test_long_text():
    text = "We met. " * 40_000 + "Doctor Ann Lee signed the sheet. " + "ha" * 60_000
    assert [v for _, v, _ in found(text)] == ["Ann Lee"]


SCHEMA = "payload_id bigint, transcript_html string"
TEXTS = [(1, "<p>Interview with Ann Lee</p><p>Thanks, Lee.</p>"), (2, "<p>That was Ann Torr on the line. Call me on 311-555-0146.</p>"), (3, "call me on 311 555 0146 or mail ann@host.test."), (4, None), (5, ""), (6, "<p>nothing</p>"), (7, "<p>Frau Ann Lee hat das unterschrieben.</p>")]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(TEXTS + TEXTS[:1], SCHEMA).selectExpr("*", "'k' as kind", "1 as value", "2 as start_pos", "3 as words")
    return {(r.payload_id, r.start_pos): r for r in pii.with_surrogates(pii.personal_data(df, "payload_id", "transcript_html"), "payload_id", "key").collect()}


def by_value(made, value):
    return {r.surrogate for r in made.values() if r.value == value}


def test_surrogates_keep_identity(made):
    assert len(made) == 7
    (full,), (part,) = by_value(made, "Ann Lee"), by_value(made, "Lee")
    (other,) = by_value(made, "Ann Torr")
    assert full.split()[1] == part and full.split()[0] == other.split()[0]  # coreference
    assert len({full.split()[0], full.split()[1], other.split()[1]}) == 3  # distinctness
    a, b = by_value(made, "311-555-0146").pop(), by_value(made, "311 555 0146").pop()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and re.fullmatch(r"3\d\d-\d{3}-\d{4}", a) and a != "311-555-0146"
    assert re.fullmatch(r"\w+@\w+\.example", by_value(made, "ann@host.test").pop())


def test_formats():
    s = lambda kind, v, **k: pii.surrogate(kind, v, "key", **k)
    assert re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]", s("id_number", "QQ 58 61 50 C"))
    assert s("name", "ANNA").isupper() and s("name", "anna").islower() and s("name", "A.")[1:] == "."
    assert s("name", "Анна", gender="f")[0].isupper() and not s("name", "Анна").isascii()
    assert re.fullmatch(r"\+44 \(0\)\d{4} \d{6}", s("phone", "+44 (0)7700 900411"))
    assert all(w in pii._DIGIT_WORDS["en"] for w in re.findall(r"\w+", s("phone", "seven six one, oh one three two")))
    assert s("address", "73 Tallow Terrace, apartment 40").split()[2] == "Terrace," and s("address", "Torfmoorstraße 9").split()[0].endswith("straße")
    assert pii.identity_of("phone", "oh seven double three") == "0733" and pii.identity_of("email", "A dot B at x dot test") == "a.b@x.test"
    assert s("name", "Anna") == s("name", "Anna") != pii.surrogate("name", "Anna", "another key")
    assert pii.gender_of("Torr", "Frau ") == "f" and pii.gender_of("Anna", "Herr ") == "m"


def test_collisions_are_resolved(spark, monkeypatch):
    # only a handful of surrogates exist: names must stay distinct all the same
    monkeypatch.setattr(pii, "_SYLLABLES", {"LATIN": ["ba"]})
    monkeypatch.setattr(pii, "_ENDINGS", {("LATIN", g): ("na",) for g in "fm"})
    texts = [(i, f"Thanks, {n}.") for i, n in enumerate(("Anno", "Berto", "Carlo", "Dario"))]
    found_ = pii.personal_data(spark.createDataFrame(texts, SCHEMA), "payload_id", "transcript_html")
    names = [pii.surrogate("name", w, "key") for w in ("Anno", "Berto")]
    assert names[0] == names[1]
    out = [r.surrogate for r in pii.with_surrogates(found_, "payload_id", "key").collect()]
    assert len(set(out)) == 4


def test_redacted(spark, rows):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    out = dict(rows(pii.redacted(df, "payload_id", "transcript_html", {"name": "[NAME]", "phone": "[PHONE]", "email": "[EMAIL]"})))
    assert out == {1: "<p>Interview with [NAME]</p><p>Thanks, [NAME].</p>", 2: "<p>That was [NAME] on the line. Call me on [PHONE].</p>", 3: "call me on [PHONE] or mail [EMAIL].", 4: None, 5: "", 6: "<p>nothing</p>", 7: "<p>Frau [NAME] hat das unterschrieben.</p>"}
    assert pii.replaced("a<i>b</i>c", [(0, 10, "X")]) == "X<i></i>"
    again = dict(rows(pii.pseudonymised(df, "payload_id", "transcript_html", "key")))
    assert again[4] is None and again[5] == "" and again[6] == "<p>nothing</p>" and "Ann" not in again[1] + again[2]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.with_surrogates(pii.personal_data(df, "payload_id", "transcript_html"), "payload_id", "key").count() == 0


def test_names_without_punctuation():
    text = "the garden torr lee could you read that out\nit in the room and later ann torr they said it\nthe garden ann lee and torr were both on leave"
    assert [m.value for m in mentions(text)] == ["torr lee", "ann torr", "ann lee", "torr"]


def test_common_words_that_are_names(spark):
    places = "<p>{} they parked outside brackworth station and down in the dale again.</p>"
    texts = [(i, places.format("so " * i)) for i in range(12)] + [(20, "<p>Doctor Dale Brackworth signed the sheet.</p>"), (21, "<p>the first marquin m brackworth could you read that out</p>")]
    texts += [(22, "<p>thanks dale brackworth the second</p>"), (23, "<p>down in the dale torr lee could you read that out</p>"), (24, "<p>outside brackworth station could you stop</p>"), (25, "<p>thanks brackworth station it is</p>")]
    texts += [(30 + i, "<p>i saw zimiak there zimiak could you read that out</p>") for i in range(12)]  # one transcript sent again
    m = {}
    for r in pii.personal_data(spark.createDataFrame(texts, SCHEMA), "payload_id", "transcript_html").collect():
        m.setdefault(r.payload_id, []).append(r.value)
    assert {k: m.get(k) for k in range(20, 26)} == {20: ["Dale Brackworth"], 21: ["marquin m brackworth"], 22: ["dale brackworth"], 23: ["torr lee"], 24: None, 25: None}
    assert all(m[30 + i] == ["zimiak"] for i in range(12))
    assert not any(i in m for i in range(12))


def test_initials_stay_different():
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "ÀÉÖÜÑÅ", "あいう"):
        for key in ("key", "another"):
            made = [pii.surrogate("name", c + ".", key) for c in alphabet]
            assert len(set(made)) == len(alphabet) and all(len(m) == 2 and m != c + "." and m[1] == "." for m, c in zip(made, alphabet, strict=True))
            assert all(pii._script(m) == pii._script(alphabet[0]) and m[0] == m[0].upper() for m in made)


@pytest.mark.parametrize(
    ("kind", "spellings"),
    [
        ("id_number", ["987654323", "987 65 4323", "987-65-4323", "nine eight seven six five four three two three"]),
        ("id_number", ["QQ586150C", "qq 58 61 50 c"]),
        ("phone", ["+44 (0)7700 900411", "+447700900411", "+44 7700 900-411"]),
        ("phone", ["0049 (30) 23125784", "00493023125784"]),
        ("phone", ["030/23125-617", "(030) 23125617"]),
        ("phone", ["0335551144", "oh double three five five five double one double four", "oh three three, triple five, one one four four"]),
    ],
)
def test_spellings_of_a_number_share_digits(kind, spellings):
    assert len({pii.identity_of(kind, v) for v in spellings}) == 1
    for attempt in range(3):
        made = [pii.surrogate(kind, v, "key", attempt) for v in spellings]
        assert len({pii.identity_of(kind, m) for m in made}) == 1 and pii.identity_of(kind, made[0]) != pii.identity_of(kind, spellings[0])
        assert all(re.sub(r"\w", "x", m) == re.sub(r"\w", "x", v) for m, v in zip(made, spellings, strict=True) if any(c.isdigit() for c in v))


def test_short_international_number_is_another():
    assert pii.identity_of("phone", "+49 30 123456") != pii.identity_of("phone", "493 012 3456")
    assert pii.surrogate("phone", "+49 30 123456", "key").startswith("+49 ")


TITLES = "doctor dr dr. mr mr. mrs mrs. ms ms. miss professor prof prof. sir madam herr herrn frau fräulein señor señora señorita sr sr. sra sra. sr.a don doña madame monsieur mme signor signora dottor dottoressa senhor senhora mevrouw meneer fru".split()
KIN = "neighbor neighbour colleague boss uncle aunt cousin brother sister friend wife husband son daughter nachbar nachbarin kollege kollegin chef chefin onkel tante bruder schwester vecino vecina hermano hermana tio tia primo prima jefe jefa voisin voisine collègue".split()


@pytest.mark.parametrize("text", [*(f"Then {t.capitalize()} Torr signed it." for t in TITLES), *(f"So my {k} Torr signed it." for k in KIN)])
def test_anchored_scan_agrees_with_plain_scanning(text):
    from parlatrace.llm import pii_rules

    at = pii_rules._anchored(text)
    assert {p.pattern: [m.span() for m in p.finditer(text)] for p in at} == {p.pattern: [m.span() for m in found_] for p, found_ in at.items()}


@pytest.mark.parametrize("at", [" at ", " ät ", " arroba ", " (at) ", "[at]", "@"])
@pytest.mark.parametrize("dot", [" dot ", " punkt ", " punto ", " (dot) ", ".", " [dot] "])
@pytest.mark.parametrize("host", ["firma", "firma dash nord bindestrich ost"])
def test_mail_signs_agree_with_plain_scanning(at, dot, host):
    from parlatrace.llm import pii_rules

    text = f"Mail anna{at}{host}{dot}de, please."
    assert [m[0] for m in pii_rules._MAIL.finditer(text)] == [text[a:b] for k, a, b in pii_rules.spans(text) if k == "email"] != []


def test_addresses_and_mail_keep_identity_and_format():
    full, short = "12 Old Mill Street", "12 old mill st."
    assert pii.identity_of("address", full) == pii.identity_of("address", short)
    a, b = pii.surrogate("address", full, "key"), pii.surrogate("address", short, "key")
    assert a.lower().split()[:3] == b.split()[:3] and a.endswith("Street") and b.endswith("st.") and a != full
    one, two = (pii.surrogate("email", v, "key") for v in ("ann.lee_42@host.test", "ann dot lee underscore 42 at host dot test"))
    assert re.fullmatch(r"[a-z]+\.[a-z]+_\d\d@[a-z]+\.example", one) and re.fullmatch(r"[a-z]+ dot [a-z]+ underscore \d\d at [a-z]+ dot example", two)
    assert pii.identity_of("email", one) == pii.identity_of("email", two)


def test_names_get_room():
    made = {pii.surrogate("name", f"Name{'abcdefghij'[i % 10]}{i}", "key", attempt=pii.LAST_ATTEMPT) for i in range(20_000)}
    assert len(made) == 20_000 and not any("[" in m for m in made)


def test_the_key_is_the_sessions(spark):
    key = pii.key_of(spark)
    assert len(key) == 64 and pii.key_of(spark) == key
