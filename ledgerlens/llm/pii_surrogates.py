"""Personal data replaced by keyed surrogates, with Spark's own functions.

Entities are e-mail and IPv4 addresses, phone, card, social security and bank account numbers, and names
behind a title. An entity is brought to a canonical form, so that the same number in another spelling is
the same entity (a North American number with and without +1 too), and gets a surrogate from a keyed digest
of it: digits stay digits, letters stay letters of their script, card and account numbers keep valid check
digits, phones keep their country code, and the surface keeps its punctuation and case.

Given names and surnames are entities of their own, whatever the title, so "Mr. John Smith", "Dr. John Smith"
and "Mr. Smith" still are one person. A given name's gender is that of most of its titles in the table. In a
text that has a full name behind a title, the full name without one is replaced too. A name has any number of
words; particles ("de", "van") stay, and an initial gets another initial. Latin, Cyrillic, Greek, Arabic, Han, Hangul
and Thai names get names of their script; those of other scripts are spelled anew with their own letters. Hyphens and
apostrophes stay where they are. As Han text has no spaces, a name there ends before a title behind it, at the end of
its run of at most four characters, or after two or three characters, so that the sentence behind it stays.

All entities of the table are then checked together: of those that share a surrogate, or whose
surrogate is an entity of the table itself, all but one take the next attempt of the digest, until none
is left. So equal entities stay equal everywhere, and different ones stay different. Numbers whose format
is used up get more digits. A phone that begins with + has seven digits at least.

Texts are cut at their entities once; only texts with a sign of an entity are, and only these are held in a
checkpoint. Defined cases: a null text stays null; texts without entities are unchanged; rows that repeat an id
or a text are treated alike; an empty table gives an empty result; other columns are kept, and where they have
the names of new ones, these get longer names. Matches don't overlap; the leftmost counts, and at one place the
kind listed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, spare_names
from ledgerlens.llm.secret_scan import let

# Patterns by kind.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Don|г-н|господин|Κος|Κύριος|κύριος|السيد"
_TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|г-жа|госпожа|Κα|Κυρία|κυρία|السيدة"
_TITLES_N = "Dr|Prof|Mx"
_TITLE_M, _TITLE_F, _TITLE_N = (f"(?:{t}|{t.upper()})" for t in (_TITLES_M, _TITLES_F, _TITLES_N))
# Java takes no repeated group in a look-behind.
_SIX_DIGITS = "[0-9][ .()/-]{0,2}" * 6
# Particles of names, Han titles behind names, and Han characters with which a sentence goes on behind a name.
PARTICLES = "de|del|della|der|den|di|da|dos|du|la|le|van|von|vom|zu|zum|ter|ten|el|al|bin|ibn|af|av|y"
_HAN_TITLES = "先生|女士|小姐|太太|教授|博士|医生|老师|经理"
_HAN_BEHIND = "昨今明在是的了去来和与说将已曾对向从到有为被把也都就不"
#: Between a title and a name; a line may end behind the dot.
_GAP = r"(?:\.?\x20|\.\n)"
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+"
_UNIT = rf"(?:(?:{PARTICLES})\x20|\p{{Lu}}\.\x20?)*{_WORD}"
_HAN = rf"\p{{IsHan}}(?:\p{{IsHan}}{{1,2}}(?={_HAN_TITLES})|\p{{IsHan}}{{1,3}}(?!\p{{IsHan}})|\p{{IsHan}}(?:(?![{_HAN_BEHIND}])\p{{IsHan}})?)"
_OTHER = r"[\p{Lo}&&[^\p{IsHan}\p{IsHangul}]][\p{L}\p{M}]*"
#: What stands before a name's word (behind the title), and the word.
NAME_WORD = rf"(\.?\x20?(?:(?:{PARTICLES})\x20)*)([\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'’-]*)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}(?:[ .()/-]{{0,2}}[0-9]{{1,4}}){{2,6}}(?<={_SIX_DIGITS}[0-9])|\([0-9]{{3}}\)[ -]?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_N}){_GAP}(?:{_UNIT}(?:\x20{_UNIT})*|{_HAN}|\p{{IsHangul}}{{2,4}}|{_OTHER}(?:\x20{_OTHER})?)",
}
# All kinds, so put that most places within a word fail at the first look.
_AT_START, _AT_DIGIT, _INSIDE = (["email", "iban"], ["ipv4", "ssn", "card"], ["ipv4", "ssn"])
_either = lambda kinds: "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
ANY = rf"(?<![0-9A-Za-z])(?:{_either(_AT_START)}|(?=[0-9])(?:{_either(_AT_DIGIT)})|{_either(['phone', 'name'])})|(?<=[A-Za-z])(?=[0-9])(?:{_either(_INSIDE)})"
#: Texts without one of these hold no entity; it is tried first because it is quick.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|\+[0-9]|(?<![\p{L}])(?:" + "|".join([_TITLE_M, _TITLE_F, _TITLE_N]) + rf"){_GAP}(?:(?:{PARTICLES})\x20)*[\p{{Lu}}\p{{Lo}}]"
TITLE = rf"^(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_N}){_GAP}"
COUNTRY = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Louis Marc Nils Oscar Paul".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Kim Robin Sasha Jules Noel Quinn Sam".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Τάσος".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("greek", "n"): "Άλεξ Κάρολ Νικόλ Ρόμπιν".split(),
    ("arabic", "m"): "أحمد خالد سامي عمر كريم ماجد نبيل ياسر".split(),
    ("arabic", "f"): "أمينة خديجة سلمى عائشة فاطمة ليلى مريم هدى".split(),
    ("arabic", "n"): "نور رضا صباح وسام".split(),
    ("han", "m"): "伟 强 军 勇 杰 涛 明 磊".split(),
    ("han", "f"): "芳 娜 敏 静 丽 艳 娟 霞".split(),
    ("han", "n"): "文 平 华 宁".split(),
    ("hangul", "m"): "민준 서준 도윤 예준 시우 하준 지호 준우".split(),
    ("hangul", "f"): "서연 서윤 지우 하윤 민서 수아 지아 윤서".split(),
    ("hangul", "n"): "지민 현우 유진 은우".split(),
    ("thai", "m"): "สมชาย ธนา วิชัย อนันต์ ประเสริฐ ณัฐ".split(),
    ("thai", "f"): "สมหญิง มาลี สุดา วรรณา พิมพ์ อรุณี".split(),
    ("thai", "n"): "นุ่น ฝน เมฆ ฟ้า".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se ta te to va".split(),
    "cyrillic": "ба бо ва ве го да де зо ка ко ла ле ма мо на не ра ро са те то".split(),
    "greek": "βα βο γα δε θα κα κο λα λε μα μο να νε πα ρα ρο σα τε".split(),
    "arabic": "با دا را سا شا فا كا لا ما نا ها يا بو دو رو سو".split(),
    "hangul": "강 고 구 권 남 노 문 민 박 배 백 서 송 신 안 양 오 유 윤 한".split(),
    "thai": "กา ขา คำ จา ชา ดา ตา ทา นา บา ปา พา มา ยา รา ลา วา สา หา อา".split(),
    "han": "安 白 曹 陈 邓 丁 方 高 郭 何 江 林 罗 马 孟 潘 任 宋 田 许".split(),
}
#: Ends of surnames, and of women's given names that are lengthened.
ENDS = {"latin": ("n", "na"), "cyrillic": ("в", "на"), "greek": ("ς", "να"), "arabic": ("ي", "ة"), "han": ("", ""), "hangul": ("", ""), "thai": ("น", "นา")}
#: Scripts whose names have a character for each syllable; surrogates have as many as the name.
SYLLABIC = ("han", "hangul")
SCRIPTS = {script: rf"\p{{Is{script.capitalize()}}}" for script in SYLLABLES}
_JOINTS = "[-'’]"
#: Attempts after which surrogates of one format count as used up, and get longer with each attempt.
SAME_FORMAT = 8


def _byte(digest: Column, i: Column | int) -> Column:
    """Byte i of a digest of 64 hexadecimal digits, over and over."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _like(value: Column, digest: Column, shift: int = 0) -> Column:
    """Digits for digits and letters for letters, by the digest; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i + shift)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.chr(b % 26 + 97)).when(c.rlike("[A-Z]"), F.chr(b % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def luhn_rest(digits: Column) -> Column:
    """What the digits add up to, modulo 10, with every second one from the right doubled."""

    def add(total: Column, x: Column) -> Column:
        doubled = x["d"] * F.when(x["i"] % 2 == 1, 2).otherwise(1)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    pairs = F.transform(F.reverse(_chars(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add) % 10


def iban_rest(country: Column, bban: Column, check: Column) -> Column:
    """An account number modulo 97, as its check digits see it."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(F.concat(bban, country, check)), F.lit(0), add)


def _pick(names: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), n % len(names))


def _joined(segments: Column, joints: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(segments, joints, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")


def _name(kind: Column, canonical: Column, gender: Column, attempt: Column, h: Column) -> Column:
    """A name of the same script, segment by segment between hyphens and apostrophes."""
    most = F.least(attempt, F.lit(8))

    def spelled(script: str, n: Column, shift: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: _pick(SYLLABLES[script], _byte(h, i + shift))), "")

    def initial(script: str, n: Column) -> Column:
        return _pick(sorted({x[0] for (own, _), names in GIVEN.items() if own == script for x in [n.lower() for n in names]}), n)

    def segment(value: Column, place: Column) -> Column:
        shift = place * 5
        letters = _chars(value)
        own = F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1 + most), lambda i: F.get(letters, _byte(h, i + shift) % F.size(letters))), "")
        out = F.when(F.length(value) == 0, "")
        for script, pattern in SCRIPTS.items():
            end, woman = ENDS[script]
            given = _pick([n.lower() for n in GIVEN[script, "n"]], _byte(h, shift))
            for g in ("m", "f"):
                given = F.when(gender == g, _pick([n.lower() for n in GIVEN[script, g]], _byte(h, shift))).otherwise(given)
            given = F.concat(given, F.when(attempt > 0, F.concat(spelled(script, most, shift), F.when(gender == "f", woman).otherwise(""))).otherwise(""))
            surname = F.concat(spelled(script, most + (F.length(value) - 1 if script in SYLLABIC else 2), shift), F.lit(end))
            # An initial, as in O'Neil or J. Smith, stays one letter, until there are too few.
            short = F.lit(script not in SYLLABIC) & (F.length(value) == 1) & ((F.length(canonical) > 1) | (kind == "given") & (attempt <= SAME_FORMAT))
            first = F.when(F.length(canonical) > 1, F.substring(surname, 1, 1)).otherwise(initial(script, _byte(h, shift)))
            out = out.when(value.rlike(pattern), F.when(short, first).when(kind == "surname", surname).otherwise(given))
        return out.otherwise(own)

    return _joined(F.transform(F.split(canonical, _JOINTS, -1), segment), F.regexp_extract_all(canonical, F.lit(_JOINTS), F.lit(0)))


def surrogate_of(kind: Column, canonical: Column, gender: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of a canonical form at an attempt."""
    digest = lambda *more: F.sha2(F.concat_ws("|", F.lit(secret), kind, *more).cast("binary"), 256)

    def of(h: Column) -> Column:
        local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
        tld = F.substring_index(domain, ".", -1)
        host = _like(F.substring_index(domain, ".", 1), digest(domain))
        # Short local parts have few surrogates, so later attempts are longer.
        longer = F.when((attempt > 0) & ((F.length(local) < 6) | (attempt > 3)), attempt.cast("string")).otherwise("")
        email = F.concat(_like(local, h), longer, F.lit("@"), host, F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("com"))
        first = F.split(canonical, "[.]")[0].cast("int")
        private = (first == 10) | canonical.rlike(r"^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
        octet = lambda i: (_byte(h, i) % 254 + 1).cast("string")
        # Where private addresses are used up, reserved ones follow.
        ipv4 = F.concat_ws(".", F.when(private & (attempt > SAME_FORMAT), (_byte(h, 0) % 15 + 240).cast("string")).when(private, F.lit("10")).otherwise((_byte(h, 0) % 110 + 11).cast("string")), octet(1), octet(2), octet(3))
        wider = F.when(attempt > SAME_FORMAT, _like(F.repeat(F.lit("0"), attempt - SAME_FORMAT), h, 10)).otherwise("")
        ssn = F.concat(F.lit("9"), _like(F.substring(canonical, 2, 8), h), wider)
        body = F.concat(F.substring(canonical, 1, 1), _like(canonical.substr(F.lit(2), F.length(canonical) - 2), h))
        check = ((10 - luhn_rest(F.concat(body, F.lit("0")))) % 10).cast("string")
        card = F.when(luhn_rest(canonical) == 0, F.concat(body, check)).otherwise(F.concat(body, (_byte(h, 31) % 10).cast("string")))
        country, bban = F.substring(canonical, 1, 2), canonical.substr(F.lit(5), F.length(canonical))
        new = _like(bban, h)
        iban = F.concat(country, F.lpad((98 - iban_rest(country, new, F.lit("00"))).cast("string"), 2, "0"), new)
        rest = F.substring_index(canonical, ":", -1)
        phone = F.concat(F.substring_index(canonical, ":", 1), F.lit(":"), (_byte(h, 30) % 8 + 2).cast("string"), _like(rest.substr(F.lit(2), F.length(rest)), h), wider)
        out = F.when(kind == "email", email)
        for name, value in (("ipv4", ipv4), ("ssn", ssn), ("card", card), ("iban", iban), ("phone", phone)):
            out = out.when(kind == name, value)
        return out.otherwise(_name(kind, canonical, gender, attempt, h))

    return let(digest(canonical, attempt.cast("string")), of)


def kind_of(value: Column) -> Column:
    """The kind of a match; names that have no title are names too."""
    out = F.lit("name")
    for kind, pattern in reversed([x for x in PATTERNS.items() if x[0] != "name"]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def parts_of(kind: Column, value: Column) -> Column:
    """(kind, canonical, lead, surface) of what is replaced in a match: one part, or each name behind the title."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    # A number without + is a North American one, by its pattern.
    signed = value.startswith("+")
    country = F.when(signed, F.coalesce(F.regexp_extract(value, COUNTRY, 1), F.lit(""))).otherwise("1")
    canonical = (
        F.when(kind.isin("email", "ipv4"), F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "phone", F.concat(country, F.lit(":"), F.when(signed, digits.substr(F.length(country) + 1, F.length(digits))).otherwise(digits)))
        .otherwise(digits)
    )
    plain = F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), F.lit("").alias("gender"), F.lit("").alias("lead"), value.alias("surface")))
    title = F.regexp_extract(value, TITLE, 0)
    gender = F.when(title.rlike(rf"^{_TITLE_M}[. ]"), "m").when(title.rlike(rf"^{_TITLE_F}[. ]"), "f").otherwise("")
    behind = value.substr(F.length(title) + 1, F.length(value))
    leads, names = (F.regexp_extract_all(behind, F.lit(NAME_WORD), F.lit(k)) for k in (1, 2))

    def part(n: Column, i: Column) -> Column:
        last = i == F.size(names) - 1
        return F.struct(F.when(last, "surname").otherwise("given").alias("kind"), F.replace(F.lower(n), F.lit("’"), F.lit("'")).alias("canonical"), F.when(last, "").otherwise(gender).alias("gender"), F.concat(F.when(i == 0, title).otherwise(""), F.get(leads, i)).alias("lead"), n.alias("surface"))

    return F.when(kind == "name", F.transform(names, part)).otherwise(plain)


def dressed(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The surrogate with the punctuation, country code and case of the surface."""

    def lay(slots: Column, new: Column) -> Column:
        """The characters of `new` in the places of letters and digits."""
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        step = lambda s, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(s["out"], new.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
        # What has no place follows behind.
        return F.aggregate(_chars(slots), start, step, lambda s: F.concat(s["out"], new.substr(s["at"], F.length(new))))

    def cased(new: Column, old: Column) -> Column:
        first = F.concat(F.upper(F.substring(new, 1, 1)), new.substr(F.lit(2), F.length(new)))
        return F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).when(F.substring(old, 1, 1) == F.upper(F.substring(old, 1, 1)), first).otherwise(new)

    name = _joined(F.zip_with(F.split(surrogate, _JOINTS, -1), F.split(surface, _JOINTS, -1), cased), F.regexp_extract_all(surface, F.lit(_JOINTS), F.lit(0)))
    # An e-mail address keeps upper case only where all of it has it.
    email = F.when(surface == F.upper(surface), F.upper(surrogate)).otherwise(surrogate)
    number = F.when((kind == "phone") & ~surface.startswith("+"), F.substring_index(surrogate, ":", -1)).otherwise(F.regexp_replace(surrogate, ":", ""))
    return F.when(kind == "email", email).when(kind == "ipv4", surrogate).when(kind.isin("ssn", "card", "iban", "phone"), lay(surface, number)).otherwise(name)


def assign_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """Distinct (kind, canonical, gender) to (kind, canonical, surrogate): different ones get different surrogates, none of which is an entity.

    Those that share a surrogate are only counted out by a minimum, which is taken before the shuffle too.
    """
    known = entities.select(F.col("kind").alias("k"), F.col("canonical").alias("c"))
    table = entities.withColumn("attempt", F.lit(0))
    while True:
        table = table.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("canonical"), F.col("gender"), F.col("attempt"), secret))
        table = table.join(known, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("c")), "left").withColumn("taken", F.col("c").isNotNull()).drop("k", "c")
        table = checkpointed(table)
        first = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical"))["canonical"].alias("first"))
        table = checkpointed(table.join(first, ["kind", "surrogate"]).withColumn("again", F.col("taken") | (F.col("canonical") != F.col("first"))).drop("taken", "first"))
        if table.where("again").isEmpty():
            return table.select("kind", "canonical", "surrogate")
        table = table.select("kind", "canonical", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


#: Parts of a text are marked off by this; a first half that a text has itself is told apart by another second half.
MARK, HALF, ESCAPED = "\x01\x03", "\x01", "\x01\x02"


def cut_at_entities(text: Column) -> Column:
    """Pieces of a text, of which every second one is an entity; full names behind titles are also found without one."""
    cut = lambda value, pattern: F.split(F.regexp_replace(value, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def again(parts: Column) -> Column:
        titled = F.transform(F.filter(parts, lambda p, i: (i % 2 == 1) & p.rlike(TITLE)), lambda p: F.regexp_replace(p, TITLE, ""))
        full = F.reverse(F.array_sort(F.transform(F.array_distinct(F.filter(titled, lambda n: n.contains(" "))), lambda n: F.struct(F.length(n).alias("n"), n.alias("name")))))
        either = F.array_join(F.transform(full, lambda x: F.concat(F.lit("\\Q"), x["name"], F.lit("\\E"))), "|")
        bare = F.concat(F.lit(r"(?<![\p{L}])(?:"), either, F.lit(r")(?![\p{L}'’-])"))
        return F.when(F.size(full) > 0, F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(cut(p, bare))))).otherwise(parts)

    return let(cut(F.replace(text, F.lit(HALF), F.lit(ESCAPED)), F.lit(ANY)), again)


def replace_entities(docs: DataFrame, secret: str = "surrogate-key-1", text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns with surrogates in the text, the length renewed where there is such a column, and n_entities and kinds."""
    count, kinds, row, parts, to, new = spare_names(docs, "n_entities", "kinds", "row", "parts", "to", "new")
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    held = checkpointed(docs.where(hinted).withColumns({row: F.monotonically_increasing_id(), parts: cut_at_entities(F.col(text))}))
    matches = held.where(F.size(parts) > 1).select(F.col(row).alias("row"), F.posexplode(F.filter(parts, lambda p, i: i % 2 == 1)).alias("i", "value"))
    found = matches.withColumn("whole", kind_of(F.col("value"))).select("row", "i", "whole", F.posexplode(parts_of(F.col("whole"), F.col("value"))).alias("j", "part")).select("row", "i", "whole", "j", "part.*")
    men, women = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    entities = found.groupBy("kind", "canonical").agg(F.when(men > women, "m").when(women > men, "f").otherwise("n").alias("gender"))
    table = assign_surrogates(checkpointed(entities), secret)
    shown = found.join(table, ["kind", "canonical"]).select("row", "i", "whole", "j", F.concat("lead", dressed(F.col("kind"), F.col("surface"), F.col("surrogate"))).alias("piece"))
    ordered = lambda place, value: F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])
    whole = shown.groupBy("row", "i").agg(F.min("whole").alias("kind"), F.array_join(ordered("j", "piece"), "").alias("shown"))
    by_row = whole.groupBy(F.col("row").alias(to)).agg(F.array_sort(F.collect_list(F.struct("i", "shown", "kind"))).alias(new))
    met = held.join(by_row, F.col(row) == F.col(to), "left")
    piece = lambda p, i: F.when(i % 2 == 1, F.get(F.col(new), ((i - 1) / 2).cast("int"))["shown"]).otherwise(F.replace(p, F.lit(ESCAPED), F.lit(HALF)))
    rebuilt = F.when(F.col(new).isNotNull(), F.array_join(F.transform(parts, piece), "")).otherwise(F.col(text))
    shape = {text: rebuilt}
    if length in docs.columns:
        shape[length] = F.when(F.col(new).isNotNull(), F.length(rebuilt).cast(dict(docs.dtypes)[length])).otherwise(F.col(length))
    listed = F.array_join(F.transform(F.coalesce(F.col(new), F.array().cast("array<struct<i:int,shown:string,kind:string>>")), lambda x: x["kind"]), ",")
    changed = met.select(*[shape.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns], F.when(F.col(new).isNotNull(), F.size(new)).otherwise(0).alias(count), listed.alias(kinds))
    same = docs.where(~hinted).select("*", F.lit(0).alias(count), F.lit("").alias(kinds))
    return changed.union(same)
