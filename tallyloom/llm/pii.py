"""Surrogates for personal data, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, small_side

# The forms of entities, honorifics and given and family names by gender and script.
HONORIFICS = {"f": r"Mrs|Ms|Miss|Mme|Madame|Frau|Señora|Sra|Госпожа", "m": r"Mr|Monsieur|Herr|Señor|Sr|Господин", "n": r"Dr|Prof|Mx"}
#: Scripts without capitals, in which a name is a run of letters.
UNCASED = {"han": r"\p{IsHan}", "kana": r"\p{IsHiragana}\p{IsKatakana}ー", "hangul": r"\p{IsHangul}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}"}
NAME = rf"(?:\p{{Lu}}(?:['’]\p{{Lu}})?\p{{L}}+(?:-\p{{Lu}}?\p{{L}}+)*|[{''.join(UNCASED.values())}&&[\p{{L}}\p{{M}}ー]]+)"
#: A place before which no word stands.
FRESH = r"(?<![\p{L}\p{N}_])"
TITLE = rf"(?:{'|'.join(HONORIFICS.values())})\.? "
FORMS = {
    # looked for from the start of a run of letters and digits only, so that a long run is read once
    "email": r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "phone": r"\+\d{1,3}[ .-]\d(?:[ .-]\d{2,4}){3,4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<![\d-])3[47]\d{13}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "person": rf"{FRESH}{TITLE}{NAME}(?: {NAME})?",
}
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Irene Julia Laura Maria Nora Paula Rosa Sara Vera".split(),
    ("latin", "m"): "Adam Bruno David Erik Felix Hugo Jonas Leon Martin Oscar Paul Viktor".split(),
    ("latin", "n"): "Alex Andrea Chris Kim Robin Sam Jamie Jordan Lee Morgan Noel Sasha".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Софья Тамара Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Кирилл Максим Олег Павел Роман Юрий".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Паша Шура".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Ζωή Μαρία Νίκη Σοφία Χαρά".split(), ("greek", "m"): "Άγγελος Γιώργος Κώστας Λεωνίδας Νίκος Πέτρος Σπύρος Φώτης".split(), ("greek", "n"): "Άλεξ Ντάνι Κιμ Χρις Ρένι Σαμ".split(),
    ("han", "f"): "美玲 静 丽华 芳 玉兰 秀英".split(), ("han", "m"): "伟 建国 强 志明 军 文博".split(), ("han", "n"): "安 宁 晓 平 一鸣 子涵".split(),
    ("kana", "f"): "さくら ゆい はな みお あおい りん".split(), ("kana", "m"): "たろう けん はると そうた りく だいち".split(), ("kana", "n"): "ひかる かおる まこと じゅん あきら のぞみ".split(),
    ("hangul", "f"): "지은 수진 민지 영희 서연 하나".split(), ("hangul", "m"): "민수 준호 철수 동현 성민 우진".split(), ("hangul", "n"): "지우 하늘 은우 수현 민 가람".split(),
    ("arabic", "f"): "مريم سلمى ليلى نور هدى سارة".split(), ("arabic", "m"): "خالد عمر سامي يوسف كريم طارق".split(), ("arabic", "n"): "صباح جهاد إحسان نضال وسام رضا".split(),
    ("hebrew", "f"): "רחל שרה תמר נועה מיכל יעל".split(), ("hebrew", "m"): "דוד יוסף משה אורי איתן גיל".split(), ("hebrew", "n"): "טל עדי שחר נועם רוני יובל".split(),
    ("devanagari", "f"): "सीता मीरा अनीता राधा कमला पूजा".split(), ("devanagari", "m"): "राम मोहन अजय विजय सुरेश राहुल".split(), ("devanagari", "n"): "किरण ज्योति शशि सुमन हर्ष नूर".split(),
}
SYLLABLES = {"latin": ["ba", "do", "fel", "gar", "hol", "kin", "lor", "man", "nev", "ros", "ser", "tol", "ver", "win"], "cyrillic": ["бар", "вол", "гор", "дан", "кор", "лин", "мар", "нов", "рос", "сав", "тур", "чер"]}
SYLLABLES |= {
    "greek": "βα δο κα λε μα νι πα ρο σα τα φι χα".split(), "han": "林 高 石 田 方 江 白 金 山 水 木 云 安 文 成 海".split(), "kana": "か き さ し た な の ま み や り わ".split(), "hangul": "강 김 나 도 문 배 서 오 조 차 최 한".split(),
    "arabic": "با دا را سا عا فا كا لا ما نا ها يا".split(), "hebrew": "בא דו גל הר לו מר נו פל רו שר תל קו".split(), "devanagari": "का गा चा ता दा ना पा बा मा रा ला सा".split(),
}
ENDINGS = {("latin", "f"): "er", ("latin", "m"): "er", ("latin", "n"): "er", ("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов", ("cyrillic", "n"): "енко", ("greek", "f"): "ίδου", ("greek", "m"): "ίδης", ("greek", "n"): "άκη"}
ENDINGS |= {(script, gender): "" for script in UNCASED for gender in "fmn"}

# Telephone country codes of one and of two digits; others have three.
COUNTRY_CODES = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

#: Every entity but a person holds a digit or an @, and a person this; other texts skip the slow pattern.
ADDRESSED = rf"{FRESH}{TITLE}{NAME}"
ANY = "|".join(f"(?:{form})" for form in FORMS.values())
#: Stands for a mention while a text is taken apart; a text that holds it is split by the pattern.
MARK = "\ue0f1"
#: Attempts that an entity gets at one length before its surrogate gets longer.
LONGER = 4


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(found: Column) -> Column:
    return reduce(lambda rest, kind: F.when(F.regexp_like(found, F.lit(f"^(?:{FORMS[kind]})$")), kind).otherwise(rest), reversed(FORMS), F.lit("other"))


def canonical(found: Column, kind: Column) -> Column:
    """What makes two mentions one entity: letters and digits for numbers, lower case for addresses; persons see `people`."""
    plain = F.lower(F.regexp_replace(found, F.lit(r"[^\p{L}\p{N}]"), F.lit("")))
    return F.when(kind.isin("email", "ip", "person"), F.lower(found)).otherwise(plain)


def _digest(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, name, attempt.cast("string")), 256)


def _number(digest: Column, at: Column | int, digits: int = 4) -> Column:
    """A number from `digits` hex digits of a digest."""
    start = (at % F.lit(60) if isinstance(at, Column) else F.lit(at % 60)) + 1
    return F.conv(F.substring(digest, start, F.lit(digits)), 16, 10).cast("int")


def _pick(items: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), F.pmod(number, F.lit(len(items))))


def _letters(found: Column, digest: Column, first: Column, after: Column) -> Column:
    """found with its ASCII letters and digits from place `first` on, up to `after`, replaced in kind and case."""

    def swapped(i: Column) -> Column:
        c, n = F.substring(found, i, F.lit(1)), _number(digest, i * 3)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(n, F.lit(26)) + 1, F.lit(1))
        new = F.when(F.regexp_like(c, F.lit("[0-9]")), F.pmod(n, F.lit(10)).cast("string")).when(F.regexp_like(c, F.lit("[a-z]")), letter).when(F.regexp_like(c, F.lit("[A-Z]")), F.upper(letter)).otherwise(c)
        return F.when((i >= first) & (i < after), new).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(found)), swapped), "")


def _digits(found: Column, digest: Column, kept: Column) -> Column:
    """found with its letters and digits replaced but for the first `kept`, by their order: layout doesn't count."""

    def swapped(i: Column) -> Column:
        c = F.substring(found, i, F.lit(1))
        order = F.char_length(F.regexp_replace(F.substring(found, F.lit(1), i), F.lit("[^A-Za-z0-9]"), F.lit("")))
        n = _number(digest, order * 3)
        letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(n, F.lit(26)) + 1, F.lit(1))
        new = F.when(F.regexp_like(c, F.lit("[0-9]")), F.pmod(n, F.lit(10)).cast("string")).when(F.regexp_like(c, F.lit("[A-Z]")), letter).otherwise(c)
        return F.when(order <= kept, c).otherwise(new)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(found)), swapped), "")


def _longer(items: list[str], digest: Column, attempt: Column) -> Column:
    """One further keyed item for every LONGER attempts, none at first: what makes the surrogates of a kind endless."""
    each = F.transform(F.sequence(F.lit(1), F.floor(attempt / LONGER).cast("int")), lambda i: _pick(items, _number(F.sha2(F.concat_ws("\x1f", digest, i.cast("string")), 256), 0)))
    return F.when(attempt >= LONGER, F.array_join(each, "")).otherwise("")


def _by(script: Column, gender: Column, table: dict[tuple[str, str], list[str] | str], number: Column | None = None) -> Column:
    """The entry of a table by script and gender, or one of its items by number."""
    out = F.lit(None).cast("string")
    for (own, sex), items in table.items():
        out = F.when((script == own) & (gender == sex), F.lit(items) if number is None else _pick(items, number)).otherwise(out)
    return out


def script_of(name: Column) -> Column:
    """The script of a name's first letters, of those that there are tables for; others count as Latin."""
    out = F.lit("latin")
    for script, letters in {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", **UNCASED}.items():
        out = F.when(F.regexp_like(name, F.lit(rf"^\P{{L}}*[{letters}]")), script).otherwise(out)
    return out


def with_luhn_digit(number: Column) -> Column:
    """A card number, in any layout, with its last digit made the check digit of the others."""
    digits = F.reverse(F.regexp_replace(F.substr(number, F.lit(1), F.char_length(number) - 1), F.lit("[^0-9]"), F.lit("")))

    def weighed(i: Column) -> Column:
        twice = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), weighed), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substr(number, F.lit(1), F.char_length(number) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def with_iban_digits(iban: Column) -> Column:
    """An IBAN, in any layout, with its third and fourth characters made the check digits of the others (mod 97)."""
    plain = F.regexp_replace(F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 2), F.lit("00")), F.lit("[^A-Z0-9]"), F.lit(""))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(plain, i, F.lit(1))
        return F.when(F.regexp_like(c, F.lit("[0-9]")), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.char_length(plain)), F.lit(0), step)
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(iban, F.lit(5)))


def family_surrogate(name: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """The family name that stands for a person: syllables in the script of its name, with an ending of its gender."""
    made = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        own = F.concat(F.initcap(_pick(syllables, _number(digest, 4))), *[_pick(syllables, _number(digest, at)) for at in (8, 12, 16)], _longer(syllables, digest, attempt))
        made = F.when(script_of(name) == script, own).otherwise(made)
    return F.concat(made, _by(script_of(name), gender, ENDINGS))


def _person(found: Column, name: Column, part: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A mention of a person: the honorific, if it has one, then what `part` says: both names, the family or the given name."""
    title = F.regexp_extract(found, rf"^{TITLE}", 0)
    given, family = _by(script_of(name), gender, GIVEN, _number(digest, 0)), family_surrogate(name, gender, digest, attempt)
    return F.concat(title, F.when(part == "full", F.concat(given, F.lit(" "), family)).when(part == "given", given).otherwise(family))


def surrogate(e: Column, key: str, attempt: Column, gender: Column) -> Column:
    """The replacement of one mention (mention, kind, name, part): same kind, layout, script and gender.

    Whatever the layout of a mention, the letters and digits of its surrogate follow from
    the entity alone, so mentions of one entity stay mentions of one.
    """
    found, kind, name = e["mention"], e["kind"], e["name"]

    def made(digest: Column) -> Column:
        domain_end = F.char_length(found) - F.char_length(F.substring_index(found, ".", -1))
        bare = F.regexp_replace(found, F.lit("[^+0-9]"), F.lit(""))
        country = F.when(bare.startswith("+"), F.coalesce(F.nullif(F.char_length(F.regexp_extract(bare, COUNTRY_CODES, 0)), F.lit(0)) - 1, F.lit(3))).otherwise(0)
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_number(digest, i * 5), F.lit(254)) + 1).cast("string")), ".")
        more = _longer(list("0123456789"), digest, attempt)
        return (
            F.when(kind == "email", F.replace(_letters(found, digest, F.lit(1), domain_end), F.lit("@"), F.concat(_longer(list("abcdefghijklmnopqrstuvwxyz"), digest, attempt), F.lit("@"))))
            .when(kind == "phone", F.concat(_digits(found, digest, country), more))
            .when(kind == "ip", F.concat(octets, F.when(attempt >= LONGER, F.concat(F.lit("."), more)).otherwise("")))
            .when(kind == "iban", F.concat(with_iban_digits(_digits(found, digest, F.lit(2))), more))
            .when(kind == "card", F.concat(with_luhn_digit(_digits(found, digest, F.when(F.regexp_like(found, F.lit(r"^\d{15}$")), 2).otherwise(1))), more))
            .when(kind == "person", _person(found, name, e["part"], gender, digest, attempt))
            .otherwise(F.concat(_digits(found, digest, F.lit(0)), more))
        )

    return let(_digest(key, kind, name, attempt), made)


def resolve_collisions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, name, attempt, gender) of the entities that need another surrogate than their texts alone would give.

    entities: distinct (kind, name, mention, genders). A person's gender is what all
    texts say: of men or women if only such honorifics or neutral ones are found,
    else neutral. An attempt fails if its surrogate is a real entity (for persons: if
    its family name is any part of a real name) or that of an entity before it by name.
    Losers try again until there are none, with longer surrogates every LONGER rounds,
    so short forms may be used up; each round joins and groups over entities only.
    """
    sexes = F.array_except("genders", F.array(F.lit("n"), F.lit("?")))
    entities = cut(entities.select("kind", "name", "mention", F.when(F.size(sexes) == 1, sexes[0]).otherwise("n").alias("gender"), (F.size("genders") > 1).alias("mixed")))
    parts = entities.select("kind", F.explode(F.when(F.col("kind") == "person", F.split("name", " ")).otherwise(F.array("name"))).alias("made"))
    real = cut(parts.distinct())
    open_, settled, fixed, attempt = entities, None, None, 0
    entity = F.struct("mention", "kind", "name", F.lit("family").alias("part"))
    while True:
        made = surrogate(entity, key, F.lit(attempt), F.col("gender"))
        family = family_surrogate(F.col("name"), F.col("gender"), _digest(key, F.col("kind"), F.col("name"), F.lit(attempt)), F.lit(attempt))
        tried = cut(open_.withColumn("made", F.when(F.col("kind") == "person", F.lower(family)).otherwise(canonical(made, F.col("kind")))))
        winners = tried.groupBy("kind", "made").agg(F.min(F.struct("name", "gender", "mixed")).alias("first")).select("kind", "made", "first.*")
        winners = winners.join(real, ["kind", "made"], "left_anti")
        if settled is not None:
            winners = winners.join(settled, ["kind", "made"], "left_anti")
        winners = cut(winners)
        taken = winners.select("kind", "made")
        settled = taken if settled is None else cut(settled.union(taken))
        own = winners.filter("mixed" if attempt == 0 else "true").select("kind", "name", F.lit(attempt).alias("attempt"), "gender")
        fixed = own if fixed is None else fixed.union(own)
        open_ = cut(open_.join(winners.select("kind", "name"), ["kind", "name"], "left_anti"))
        attempt += 1
        if open_.isEmpty():
            return cut(fixed)


def people(found: Column) -> Column:
    """What a text says of persons, from its mentions (mention, kind) in honorific form: an array of (rest, names, name, gender).

    rest is the mention without its honorific. A family name alone is the person of both names that has it, if the text has just one.
    """
    title = rf"^{TITLE}"

    def described(m: Column) -> Column:
        gender = F.lit("n")
        for sex in ("f", "m"):
            gender = F.when(F.regexp_like(m["mention"], F.lit(rf"^(?:{HONORIFICS[sex]})(?![\p{{L}}])")), sex).otherwise(gender)
        rest = F.regexp_replace(m["mention"], F.lit(title), F.lit(""))
        return F.struct(rest.alias("rest"), F.lower(rest).alias("low"), gender.alias("gender"))

    persons = F.transform(F.filter(found, lambda m: m["kind"] == "person"), described)

    def named(all_: Column) -> Column:
        both = F.array_distinct(F.transform(F.filter(all_, lambda p: p["low"].contains(" ")), lambda p: p["low"]))

        def name(p: Column, both: Column) -> Column:
            bearers = F.filter(both, lambda b: F.substring_index(b, " ", -1) == p["low"])
            return F.when(~p["low"].contains(" ") & (F.size(bearers) == 1), F.get(bearers, F.lit(0))).otherwise(p["low"])

        return F.transform(all_, lambda p: F.struct(p["rest"].alias("rest"), name(p, both).alias("name"), p["gender"].alias("gender")))

    return F.when(F.size(persons) > 0, let(persons, named)).otherwise(F.array().cast("array<struct<rest:string,name:string,gender:string>>"))


def bare_forms(persons: Column) -> Column:
    """(form, name, part) of what may name a text's persons without an honorific, longest first; a name of two persons names neither."""
    both = F.filter(persons, lambda p: p["rest"].contains(" "))

    def forms(ps: Column) -> Column:
        whole = F.transform(both, lambda p: F.struct(p["rest"].alias("form"), p["name"].alias("name"), F.lit("full").alias("part")))
        family = F.transform(ps, lambda p: F.struct(F.substring_index(p["rest"], " ", -1).alias("form"), p["name"].alias("name"), F.lit("family").alias("part")))
        given = F.transform(both, lambda p: F.struct(F.substring_index(p["rest"], " ", 1).alias("form"), p["name"].alias("name"), F.lit("given").alias("part")))
        every = F.array_distinct(F.concat(whole, family, given))

        def single(every: Column) -> Column:
            return F.filter(every, lambda f: F.size(F.filter(every, lambda g: (g["form"] == f["form"]) & ((g["name"] != f["name"]) | (g["part"] != f["part"])))) == 0)

        return let(every, single)

    ordered = F.transform(F.array_sort(F.transform(forms(persons), lambda f: F.struct((-F.char_length(f["form"])).alias("size"), f.alias("f")))), lambda x: x["f"])
    return F.when(F.size(persons) > 0, ordered).otherwise(F.array().cast("array<struct<form:string,name:string,part:string>>"))


def find_entities(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with `pattern`, the pattern of what is personal in the text, and `entities`, its matches in order as (mention, kind, name, part, gender)."""
    text = F.col(text_col)
    likely = text.contains("@") | F.regexp_like(text, F.lit("[0-9]")) | F.regexp_like(text, F.lit(ADDRESSED))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("found", F.when(likely, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    rows = rows.withColumn("found", F.transform("found", lambda m: F.struct(m.alias("mention"), kind_of(m).alias("kind"))))
    rows = rows.withColumn("people", people(F.col("found")))
    rows = rows.withColumn("forms", bare_forms(F.col("people")))
    bare = F.concat(F.lit(rf"{ANY}|{FRESH}(?:"), F.array_join(F.transform("forms", lambda f: f["form"]), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    rows = rows.withColumn("pattern", F.when(F.size("forms") > 0, bare).otherwise(F.lit(ANY)))
    again = F.transform(F.regexp_extract_all(text, F.col("pattern"), F.lit(0)), lambda m: F.struct(m.alias("mention"), kind_of(m).alias("kind")))
    rows = rows.withColumn("found", F.when(F.size("forms") > 0, again).otherwise(F.col("found")))

    def gender(name: Column) -> Column:
        """Of the person in this text: a sex if honorifics of one alone are found."""
        sexes = F.array_distinct(F.transform(F.filter("people", lambda p: (p["name"] == name) & (p["gender"] != "n")), lambda p: p["gender"]))
        return F.when(F.size(sexes) == 1, sexes[0]).otherwise("n")

    def described(m: Column) -> Column:
        own = F.get(F.filter("people", lambda p: p["rest"] == F.regexp_replace(m["mention"], F.lit(rf"^{TITLE}"), F.lit(""))), F.lit(0))
        form = F.get(F.filter("forms", lambda f: f["form"] == m["mention"]), F.lit(0))
        titled = m["kind"] == "person"
        name = F.when(titled, own["name"]).when(m["kind"] == "other", form["name"]).otherwise(canonical(m["mention"], m["kind"]))
        part = F.when(titled, F.when(own["rest"].contains(" "), "full").otherwise("family")).otherwise(form["part"])
        kind = F.when(m["kind"] == "other", "person").otherwise(m["kind"])
        return F.struct(m["mention"].alias("mention"), kind.alias("kind"), name.alias("name"), part.alias("part"), F.when(kind == "person", gender(name)).otherwise("?").alias("gender"))

    entities = F.when(F.size("found") > 0, F.transform("found", described)).otherwise(F.array().cast("array<struct<mention:string,kind:string,name:string,part:string,gender:string>>"))
    return rows.withColumn("entities", entities).drop("found", "people", "forms")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_entities, n_email, ..., text) for each document, with surrogates in place of personal data.

    key: whoever has it can link surrogates of equal entities across runs.

    A surrogate is made from a keyed digest of the entity, within the text's own
    row: addresses keep their layout and top-level domain, numbers their grouping
    and country code, cards their network's digit and a right check digit, IBANs their
    country and right check digits, names their honorific, gender and script (Latin,
    Cyrillic, Greek, Han, kana, Hangul, Arabic, Hebrew, Devanagari). A person is found by
    an honorific; within the text the same name without one, and its family or given
    name alone, are mentions of that person unless two persons of the text share them.
    Equal entities get equal surrogates in all documents. Distinct entities must stay
    distinct: the corpus' entities (counted apart from the texts) are checked, and
    the few whose surrogate is taken, or of whose gender texts differ, are joined to the
    documents that mention them. Where the surrogates of a layout are used up they
    get longer, numbers beyond their format.

    Edge cases: null stays null with zero counts; texts without personal data come
    back unchanged; texts of any length are read whole; a repeated doc_id is
    rewritten in each of its rows, and so is a null one; other columns are ignored,
    whatever their names.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = find_entities(rows, "text")
    mentions = cut(rows.filter(F.size("entities") > 0).select(F.xxhash64("text").alias("print"), F.explode(F.array_distinct(F.transform("entities", lambda e: F.struct(*[e[c].alias(c) for c in ("kind", "name", "mention", "gender")])))).alias("e")).select("print", "e.*"))
    distinct = mentions.groupBy("kind", "name").agg(F.min("mention").alias("mention"), F.collect_set("gender").alias("genders"))
    fixed = resolve_collisions(distinct, key)
    again = mentions.select("print", "kind", "name").join(small_side(fixed), ["kind", "name"]).groupBy("print")
    again = cut(again.agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "name"), F.struct("attempt", "gender")))).alias("exceptions")))

    again = again.withColumnRenamed("print", "__print")
    joined = rows.withColumn("__own", F.when(F.size("entities") > 0, F.xxhash64("text"))).join(small_side(again), F.col("__own") == F.col("__print"), "left")

    def replaced(e: Column) -> Column:
        own = F.try_element_at("exceptions", F.concat_ws("\x1f", e["kind"], e["name"]))
        return surrogate(e, key, F.coalesce(own["attempt"], F.lit(0)), F.coalesce(own["gender"], e["gender"]))

    # the built-in split compiles its pattern for each row, so mentions are marked and the text is split at the mark
    marked = F.split(F.regexp_replace(text, F.col("pattern"), F.lit(MARK)), MARK, -1)
    between = F.when(text.contains(MARK), F.split(text, F.col("pattern"), -1)).otherwise(marked)
    woven = let(between, lambda b: F.concat(F.get(b, F.lit(0)), F.array_join(F.transform("entities", lambda e, i: F.concat(replaced(e), F.get(b, i + 1))), "")))

    def counted(kind: str) -> Column:
        return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    columns = ["doc_id", F.size("entities").cast("long").alias("n_entities"), *[counted(kind) for kind in FORMS]]
    return joined.select(*columns, F.when(F.size("entities") > 0, woven).otherwise(text).alias("text"))
