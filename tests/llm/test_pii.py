import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

ROWS = [
    (1, "Mail le.42@mail4.example.com or LE.42@Mail4.Example.com now, le.43@mail4.example.com too."),
    (2, "Call +1 (678) 555-5272, 678-555-5272 or 678 555 5273. Card 4111 1111 1111 1111 and 4111111111111112."),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" from 152.143.123.131, 152.143.123.131. SSN 123-45-6789'),
    (4, "Mrs. Anna Schmidt met Mr Schmidt and Г-жа Анна Петрова. DE89 3704 0044 0532 0130 00"),
    (5, "Nothing here, version 2.0, in 1999 or 10 of 20."),
    (6, None),
    (7, ""),
    (7, ""),
    (8, "x" * 200_000 + " a@b.example.org"),
]


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame([(*r, "k", 3) for r in ROWS], "doc_id long, text string, kind string, n_found int")
    rows = pii.replaced(df).collect()
    assert len(rows) == len(ROWS)
    return {r.doc_id: r for r in rows}


def test_forms_and_coreference(out):
    a, b, c = re.fullmatch(r"Mail (\S+) or (\S+) now, (\S+) too\.", out[1].text).groups()
    assert a == b != c and re.fullmatch(r"[a-z]{2}\.\d\d@mail\d+\.example\.org", a) and out[1].n_entities == 3
    p, q, r, card, other = re.fullmatch(r"Call \+1 \((\d{3}\) \d{3}-\d{4}), (\d{3}-\d{3}-\d{4}) or (\d{3} \d{3} \d{4})\. Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\.", out[2].text).groups()
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(p) == digits(q) != digits(r) and digits(q) != "6785555272"
    luhn = lambda x: sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(x[::-1])) % 10
    assert luhn(digits(card)) == 0 and digits(card) != "4111111111111111" != other
    token, ip, again, ssn = re.fullmatch(r'token = "([0-9a-f]{40})" from ([\d.]+), ([\d.]+)\. SSN (\d{3}-\d\d-\d{4})', out[3].text).groups()
    assert ip == again != "152.143.123.131" and token[:6] != "24be64" and ssn != "123-45-6789"
    given, family, same, her, hers, iban = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Г-жа (\w+) (\w+)\. (DE\d\d(?: \d{4}){4} \d\d)", out[4].text).groups()
    assert given in pii.GIVEN["f"] and family == same != "Schmidt" and her in pii.GIVEN_CYRILLIC["f"] and re.fullmatch("[А-Я][а-я]+", hers) and iban != "DE89 3704 0044 0532 0130 00"


def test_other_texts_stay(out):
    assert out[5].text == ROWS[4][1] and out[6].text is None and out[7].text == "" and out[5].n_entities == out[6].n_entities == 0
    assert out[8].text.startswith("x" * 200_000 + " ") and "a@b.example.org" not in out[8].text


def test_surrogates_stay_distinct_where_draws_collide(spark, monkeypatch):
    """With surrogates of few values, cores draw again until all differ and none is an entity of the corpus."""
    monkeypatch.setattr(pii, "surrogate_core", lambda kind, core, draw, key: F.concat(F.lit("10.0.0."), (F.xxhash64(core, draw) % 97 + 97).cast("string")))
    df = spark.createDataFrame([(i, f"from 10.0.0.{i} to 10.0.0.{i + 1}") for i in range(40)], "doc_id long, text string")
    moved, n = pii.redrawn(df, "k")
    assert n > 0 and moved.count() == n
    found = {}
    for r in pii.replaced(df, "k").collect():
        a, b = re.fullmatch(r"from (\S+) to (\S+)", r.text).groups()
        assert found.setdefault(r.doc_id, a) == a and found.setdefault(r.doc_id + 1, b) == b
    assert len(set(found.values())) == len(found) == 41 and not {f"10.0.0.{i}" for i in range(41)} & set(found.values())


def test_persons_stay_apart_by_given_names(spark):
    """More given names under one family name than the list has, some of them in it, in two scripts and genders."""
    latin = [*pii.GIVEN["m"], *(f"Jo{c}n" for c in "abcdefgijk")]
    cyrillic = [*pii.GIVEN_CYRILLIC["f"], "Анна", "Мария", "Ольга"]
    people = [f"Mr {g} Smith" for g in latin] + [f"Г-жа {g} Петрова" for g in cyrillic] + ["Mr John Brown", "Mr John Smith", "Ms John Smith", "Mr Smith"]
    df = spark.createDataFrame([(i, f"Here {p} and {p}.") for i, p in enumerate(people)], "doc_id long, text string")
    found = {}
    for r in pii.replaced(df).collect():
        a, b = re.fullmatch(r"Here (.+) and (.+)\.", r.text).groups()
        assert a == b and r.n_entities == 2
        found[people[r.doc_id]] = a.split()
    assert len({" ".join(x) for x in found.values()}) == len(people)
    for p, new in found.items():
        assert len(new) == len(p.split()) and not {*new[1:]} & {*p.split()[1:]}
        assert len(new) < 3 or new[1] not in {x.split()[1] for x in people if len(x.split()) > 2 and x.split()[0] == new[0]}
    assert found["Mr John Brown"][1] == found["Mr John Smith"][1] and found["Mr John Smith"][2] == found["Mr Smith"][1] == found["Ms John Smith"][2]


def test_names_do_not_run_out(spark, monkeypatch):
    """More family names than the first draw's syllables make."""
    monkeypatch.setattr(pii, "SYLLABLES", ["ba", "be"])
    names = [f"S{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst"]
    df = spark.createDataFrame([(i, f"Mr {n}") for i, n in enumerate(names)], "doc_id long, text string")
    assert len({r.text for r in pii.replaced(df).collect()} - {f"Mr {n}" for n in names}) == len(names)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, pii.replaced(docs)))
    assert before.keys() == after.keys() and pii.replaced(docs.limit(0)).count() == 0
    private = re.compile(r"[^\s@]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)|\b[0-9a-f]{40}\b|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")
    seen = 0
    for d, r in before.items():
        for x in set(private.findall(r.text)):
            seen += 1
            assert x not in after[d].text
        if not private.search(r.text):
            assert r.text == after[d].text
    assert seen > 3


def test_mentions_without_a_title(spark):
    texts = ["Mrs. Anna Schmidt spoke. Schmidt left. Anna Schmidt came back; Schmidts stay, Anna's too.", "Schmidt and Anna are nobody here.", "Jones saw Dr Eve Jones, Mr Lee and Lee."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replaced(df).collect()}
    given, family = re.match(r"Mrs\. (\w+) (\w+) spoke", out[0]).groups()
    assert out[0] == f"Mrs. {given} {family} spoke. {family} left. {given} {family} came back; Schmidts stay, {given}'s too." and {given, family} & {"Anna", "Schmidt"} == set()
    assert out[1] == texts[1]
    jones, eve, same, lee, again = re.fullmatch(r"(\w+) saw Dr (\w+) (\w+), Mr (\w+) and (\w+)\.", out[2]).groups()
    assert jones == same != "Jones" and lee == again != "Lee" and lee != jones and eve in pii.GIVEN["f"] + pii.GIVEN["m"]


def test_numbers_of_other_countries_and_forms(spark):
    same = ["+1 678 555 5272", "+1 (678) 555-5272", "678.555.5272", "+16785555272"]
    others = ["+44 678 555 5272", "+49 30 1234567", "+33 1 23 45 67 89", "+33 1 23 45 67 80", "fe80:0:0:0:1:2:3:4", "2001:db8::ff00:42:8329", "0A" * 20, "0b" * 70]
    df = spark.createDataFrame(list(enumerate(f"at {x} now" for x in same + others)), "doc_id long, text string")
    out = [r.text[3:-4] for r in sorted(pii.replaced(df).collect())]
    form = lambda x: re.sub("[0-9a-f]", "0", re.sub("[0-9A-F]", "0", x)) if ":" in x or len(x) > 30 else re.sub("[0-9]", "0", x)
    assert [form(x) for x in out] == [form(x) for x in same + others] and all(a != b for a, b in zip(out, same + others))
    assert len({re.sub(r"\D", "", x)[-10:] for x in out[: len(same)]}) == 1 and len({*out[len(same) - 1 :]}) == len(others) + 1
    assert out[4][:3] == "+44" and out[5][:3] == "+49"
    plain = ["12:30:45 and 1999", "std::map", "1 + 22 33", "v1.2.3", "+5 points"]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert [r.text for r in sorted(pii.replaced(df).collect())] == plain


def test_distinct_and_coreferent_by_brute_force(spark):
    """Every entity of many texts, found by plain regular expressions: one surrogate for one core in all texts, different
    surrogates for different cores, none that is a core of the corpus."""
    import random

    rng = random.Random(6)
    mail = [f"{a}{b}@x{i % 7}.example.com" for i, (a, b) in enumerate((a, b) for a in "abcde" for b in "fghij")]
    phones = [f"{rng.randrange(200, 999)}-555-{rng.randrange(10**4):04}" for _ in range(40)]
    people = [f"{t} {g} {f}" for t, g in (("Mr", "Paul"), ("Mr", "Piotr"), ("Ms", "Rosa"), ("Ms", "Ines")) for f in ("Kling", "Wolff", "Adler", "Sauer")]
    rows = []
    for i in range(300):
        m, p, n = rng.choice(mail), rng.choice(phones), rng.choice(people)
        rows.append((i, f"{n} <{rng.choice((m, m.upper()))}> {rng.choice((p, p.replace('-', ' '), '+1 ' + p))} ; {n.split()[2]}", m, p, n))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replaced(df).collect()}
    seen = {}
    for i, _, m, p, n in rows:
        name, mail_, phone, family = re.fullmatch(r"(.+) <(.+)> (.+) ; (\w+)", out[i]).groups()
        title, given, last = name.split()
        assert title == n.split()[0] and family == last
        for kind, core, new in (("mail", m, mail_), ("phone", p, re.sub(r"\D", "", phone)[-10:]), ("family", n.split()[2], last), ("given " + title, n.split()[1], given)):
            assert seen.setdefault((kind, core), new) == new
    for kind in {k for k, _ in seen}:
        new = [v for (k, _), v in seen.items() if k == kind]
        assert len({*new}) == len(new) and not {*new} & {re.sub("-", "", c) if kind == "phone" else c for k, c in seen if k == kind}
