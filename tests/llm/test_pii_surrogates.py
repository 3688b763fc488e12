"""Surrogates keep kind, format, gender and script, stay distinct, and stay the same for the same entity."""

import random
import re

import pytest
import regex

from ledgerlens.llm import pii_surrogates as P

TEXTS = {
    1: "write jo.98@mail5.example.com or JO.98@MAIL5.EXAMPLE.COM, call +1 (656) 555-6669 or +16565556669.",
    2: "host 144.137.247.239 and 10.0.0.7, card 4111 1111 1111 1111 or 4111111111111111, ssn 123-45-6789",
    3: "Mr. John Smith met Mrs. Anna Smith and MR. SMITH; Herr Müller; г-жа Иванова",
    4: "DE89 3704 0044 0532 0130 00 and 9321955660381726 in text###",
    5: "nothing here 12 345 v2.0.1.5.6 and 2024-01-02",
    6: None,
    7: "",
    8: "a1@b.com " * 300 + "x" * 100_000 + " (664) 555-5990",
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "k", 9, len(t or "")) for i, t in TEXTS.items()] + [(1, TEXTS[1], "k", 9, 0), (1, "other jo.98@mail5.example.com", "k", 9, 0)]
    return P.replace_entities(spark.createDataFrame(data, "doc_id bigint, text string, kind string, i int, n_chars bigint")).collect()


def text_of(rows, i):
    return next(r["text"] for r in rows if r["doc_id"] == i)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (2 * d > 9) for k, d in enumerate(digits)) % 10


def test_rows_and_columns(rows):
    assert len(rows) == len(TEXTS) + 2
    assert list(rows[0].asDict()) == ["doc_id", "text", "kind", "i", "n_chars", "n_entities", "kinds"]
    assert text_of(rows, 5) == TEXTS[5]
    assert text_of(rows, 6) is None
    assert text_of(rows, 7) == ""


def test_nothing_of_the_entities_is_left(rows):
    everything = " ".join(r["text"] or "" for r in rows)
    for part in ("jo.98@", "555-6669", "5556669", "144.137.247.239", "10.0.0.7", "4111 1111 1111", "123-45-6789", "John", "Smith", "SMITH", "Müller", "Иванова", "0532", "9321955660381726", "a1@b.com", "555-5990"):
        assert part not in everything, part


def test_coreference(rows):
    first = text_of(rows, 1)
    small, large = re.findall(r"\S+@[\w.-]+\w", first)
    assert small.upper() == large and small != large
    other = [r["text"] for r in rows if r["doc_id"] == 1 and r["text"].startswith("other")]
    assert other[0] == f"other {small}"
    a, b = re.findall(r"\+1[0-9 ()-]+[0-9]", first)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)
    spaced, plain = re.search(r"card ([\d ]+\d) or (\d+)", text_of(rows, 2)).groups()
    assert spaced.replace(" ", "") == plain
    assert luhn(plain) == 0
    names = text_of(rows, 3)
    husband, wife, upper = re.match(r"Mr\. \w+ (\w+) met Mrs\. \w+ (\w+) and MR\. (\w+)|Mr\. \w+ (\w+) met Mrs\. \w+ (\w+)", names).groups()[:3]
    assert husband == wife
    assert upper in (None, husband.upper())


def test_gender_and_script(rows):
    names = text_of(rows, 3)
    man, woman = re.search(r"Mr\. (\w+) \w+ met Mrs\. (\w+) ", names).groups()
    assert man in P.GIVEN["latin", "m"]
    assert woman in P.GIVEN["latin", "f"]
    assert re.search("г-жа [А-Я][а-я]+", names)


def test_account_number_is_valid(rows):
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", text_of(rows, 4))[0].replace(" ", "")
    moved = iban[4:] + iban[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_distinct_under_collisions(spark):
    entities = spark.createDataFrame([("given", f"name{k}", "m") for k in range(400)] + [("email", f"{c}@x.com", "n") for c in "abcdefghijklmnopqrstuvwxyz"] + [("surname", "baben", "n")], "kind string, canonical string, gender string")
    got = P.assign_surrogates(entities, "k").collect()
    pairs = {(r["kind"], r["surrogate"]) for r in got}
    assert len(got) == 427 == len(pairs)
    assert not pairs & {(r["kind"], r["canonical"]) for r in got}


def test_used_up_formats_get_longer(spark):
    entities = spark.createDataFrame([("phone", f"1:{n}", "n") for n in range(100)] + [("phone", f"7:{n:02d}", "n") for n in range(100)], "kind string, canonical string, gender string").distinct()
    got = P.assign_surrogates(entities, "k").collect()
    assert len({r["surrogate"] for r in got}) == len(got) == entities.count()
    assert not {r["surrogate"] for r in got} & {r["canonical"] for r in got}


def test_signed_numbers_are_no_phones(spark):
    rows = [(k, f"gain of +{k} and (+25 000) or +1 2 3", 0) for k in range(100, 200)] + [(1, "call +1 2 3 4 5 6 77777 or +385 1 234 or +16565556669", 0)]
    out = {r["doc_id"]: r for r in P.replace_entities(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()}
    assert all(out[k]["text"] == t and out[k]["n_entities"] == 0 for k, t, _ in rows[:-1])
    assert out[1]["kinds"] == "phone,phone" and out[1]["text"].startswith("call +1 2 3 4 5 6 77777 or +385 ")


PEOPLE = {
    1: "Mr. John Smith saw Dr. John Smith. John Smith left; Johnson Smithson and John Smithers stayed.",
    2: "Dr. John Smith and Mrs. John Smith, Mr. John Smith",
    3: "Mr. Γιάννης Παπαδόπουλος and Dr. 王伟 and Dr. محمد علي and г-н Иван Петров and Dr. משה",
    4: "Mr. Jean-Luc O'Neil met Mr. JEAN-LUC O'NEIL and Mr. Jean-Luc O’Neil",
    5: "call 212-555-1234 or +1 212 555 1234 or (212) 555-1234",
    6: "marks \x01\x03 and \x01\x02 stay, a@b.org goes \x01",
}


@pytest.fixture(scope="module")
def people(spark):
    docs = spark.createDataFrame([(i, t, 7, "x", "y", len(t)) for i, t in PEOPLE.items()], "doc_id bigint, text string, n_entities int, parts string, Row string, n_chars bigint")
    return {r["doc_id"]: r for r in P.replace_entities(docs).collect()}


def test_one_person_under_all_titles(people):
    text = people[1]["text"]
    name = re.match(r"Mr\. (\w+ \w+) saw", text)[1]
    assert text == f"Mr. {name} saw Dr. {name}. {name} left; Johnson Smithson and John Smithers stayed."
    assert name.split()[0] in P.GIVEN["latin", "m"]  # two Mr. against one Mrs. in the table
    assert people[2]["text"] == f"Dr. {name} and Mrs. {name}, Mr. {name}"
    assert people[1]["kinds"] == "name,name,name"


def test_names_keep_their_script_and_joints(people):
    greek, han, arabic, cyrillic, hebrew = re.fullmatch(r"Mr\. (.+) and Dr\. (.+) and Dr\. (.+) and г-н (.+) and Dr\. (.+)", people[3]["text"]).groups()
    for name, low, high, old in ((greek, 0x370, 0x3FF, "Γιάννης Παπαδόπουλος"), (han, 0x4E00, 0x9FFF, "王伟"), (arabic, 0x600, 0x6FF, "محمد علي"), (cyrillic, 0x400, 0x4FF, "Иван Петров"), (hebrew, 0x590, 0x5FF, "משה")):
        assert name != old
        assert all(low <= ord(c) <= high for c in name.replace(" ", ""))
        assert name.count(" ") == old.count(" ")
    first, upper, curly = re.fullmatch(r"Mr\. (.+) met Mr\. (.+) and Mr\. (.+)", people[4]["text"]).groups()
    assert re.fullmatch(r"[A-Z]\w+-[A-Z]\w+ [A-Z]'[A-Z]\w+", first)
    assert upper == first.upper()
    assert curly == first.replace("'", "’")


def test_one_number_in_all_formats(people):
    plain, signed, bracketed = re.fullmatch(r"call (.+) or (.+) or (.+)", people[5]["text"]).groups()
    assert re.fullmatch(r"\d{3}-\d{3}-\d{4}", plain) and plain != "212-555-1234"
    assert signed == "+1 " + plain.replace("-", " ")
    assert bracketed == f"({plain[:3]}) {plain[4:]}"


def test_clashing_names_and_marks(people):
    row = people[6].asDict()
    assert list(row) == ["doc_id", "text", "n_entities", "parts", "Row", "n_chars", "n_entities_", "kinds"]
    assert (row["n_entities"], row["parts"], row["Row"], row["n_entities_"]) == (7, "x", "y", 1)
    assert re.fullmatch("marks \x01\x03 and \x01\x02 stay, .@.*[.]example[.]org goes \x01", row["text"])
    assert row["n_chars"] == len(row["text"])


def test_equals_plain_replacement(spark):
    """Every text again with Python's expressions: what lies between entities stays, and entities map one to one."""
    rng = random.Random(5)
    made = [
        lambda: f"{rng.choice('abc')}{rng.randrange(9)}@mail{rng.randrange(3)}.com",
        lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        lambda: f"{rng.randrange(100, 1000)}-{rng.randrange(10, 100)}-{rng.randrange(1000, 10000)}",
        lambda: f"+1 {rng.randrange(200, 210)} 555 {rng.randrange(1000, 1010)}",
        lambda: f"Mr. {rng.choice(['Adam', 'Zed'])} {rng.choice(['Smith', 'Jones', 'Lee'])}",
        lambda: f"v{rng.randrange(30)}", lambda: rng.choice(["word", "Word", "12 345", "a-b"]),
    ]
    texts = [", ".join(rng.choice(made)() for _ in range(rng.randrange(12))) for _ in range(150)]
    got = {r["doc_id"]: r for r in P.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    entity = regex.compile("|".join(f"(?:{p})" for p in P.PATTERNS.values()))
    there, back = {}, {}
    for i, text in enumerate(texts):
        old, new = text.split(", "), got[i]["text"].split(", ")
        assert len(old) == len(new)
        assert got[i]["n_entities"] == sum(bool(entity.fullmatch(x)) for x in old)
        for a, b in zip(old, new, strict=True):
            assert (a == b) != bool(entity.fullmatch(a))
            for x, y in zip(a.split(), b.split(), strict=True) if a.startswith("Mr.") else [(a, b)]:
                assert there.setdefault(x, y) == y
                assert back.setdefault(y, x) == x


def test_no_python_in_the_plan(spark):
    out = P.replace_entities(spark.createDataFrame([(1, "a@b.com")], "doc_id bigint, text string"))
    assert "Python" not in out._jdf.queryExecution().toString()


def test_empty_table(spark):
    assert P.replace_entities(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_names_of_many_forms(spark):
    """Sentences behind names stay, particles and initials are known, and no word of a name is left in clear."""
    texts = [
        "Dr. 王伟先生昨天去了北京开会然后回家", "Dr. 王伟昨天去了北京", "Mr. 王小明", "Mr. Anna Maria Berta Carla Smith went",
        "Mr. de Gaulle, Mr. Charles de Gaulle", "Mr J. Smith met Mr. J. R. Smith and Mr. J.R.R. Tolkien.", "Mr. 김철수 씨가 왔다", "Mr. สมศักดิ์ ใจดี", "Mr.\nSmith left", "Mr. and so on",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["text"] for r in sorted(P.replace_entities(docs, "k").select("doc_id", "text").collect())]
    assert re.fullmatch("Dr. (..)先生昨天去了北京开会然后回家", got[0])[1] == re.fullmatch("Dr. (..)昨天去了北京", got[1])[1] != "王伟"
    assert re.fullmatch("Mr. ...", got[2]) and "王" not in got[2]
    assert re.fullmatch(r"Mr\.(?: [A-Z][a-z]+){5} went", got[3]) and not set(got[3].split()) & {"Anna", "Maria", "Berta", "Carla", "Smith"}
    assert re.fullmatch(r"Mr\. de ([A-Z][a-z]+), Mr\. [A-Z][a-z]+ de \1", got[4]) and "Gaulle" not in got[4]
    first = re.fullmatch(r"Mr ([A-Z])\. ([A-Z][a-z]+) met Mr\. \1\. ([A-Z])\. \2 and Mr\. \1\.\3\.\3\. ([A-Z][a-z]+)\.", got[5])
    assert first and first[1] != first[3] and first[2] != "Smith" and first[4] not in ("Tolkien", first[2])
    assert re.fullmatch("Mr. [가-힣]{3} 씨가 왔다", got[6]) and not set("김철수") & set(got[6])
    assert not any(w in got[7] for w in ("สมศักดิ์", "ใจดี")) and sorted(got[7].split()[-1]) != sorted("ใจดี")
    assert got[8] == f"Mr.\n{first[2]} left"
    assert got[9] == texts[9]
