"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are e-mail addresses, telephone, card and social security numbers,
IPv4 addresses, hexadecimal and access keys, passwords, and names after a
title, with what else the document says of them without it: given name and
surname, or the surname alone, as whole words in the case of the titled mention.
Each distinct entity of the corpus gets one surrogate, drawn with a key
(SHA-512) from what has the same type and format: letters for letters, digits
for digits, octets for octets, names of the same gender and script for names.
An entity is known by its canonical form (lower case, digits only for numbers),
so all its mentions, in whatever format or case, get the same surrogate, poured
into the format of the mention. No two entities of a type share a surrogate and
no surrogate is a real entity of the corpus: what collides draws again until
nothing does.

Cases: a null text stays null; a text without entities is unchanged; rows that
repeat a ``doc_id`` are each replaced by their own text; a null ``doc_id`` is a
value like others; an empty table gives an empty result. Other columns are
carried along; one named like an added column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import carried, materialise, text_key

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES_MALE = ["Mr", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Sir", "Lord", "господин"]
_TITLES_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "Mlle", "Doña", "Lady", "Dame", "госпожа"]
#: Their given names are drawn from the male ones.
_TITLES_OTHER = ["Dr", "Dra", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "доктор", "профессор"]
_TITLE = "(?:" + "|".join(sorted(_TITLES_MALE + _TITLES_FEMALE + _TITLES_OTHER, key=len, reverse=True)) + ")"
_TITLE = rf"{_TITLE}(?:\.? {_TITLE})*(?=\.? )"
_NAME = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
#: Entities by type, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,12})",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])"
    r"|(?<![\w.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?!\w|\.[0-9])|(?<![\w+])\+(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "key": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "password": r"(?<![A-Za-z])(?i:password|passwd|pwd) ?[=:] ?[\"']?(?=(?:[!-~&&[^\"'<>,;]]*?[A-Za-z0-9]){4})[!-~&&[^\"'<>,;]]{6,}",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? {_NAME}(?: {_NAME})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Surrogate names (fixed values).
NAMES = {
    "male latin": "Adam Albert Anton Bernard Carl Daniel David Edgar Felix Frank Georg Hugo Jonas Julian Karl Leon Louis Lucas Martin Max Oscar Paul Robert Victor".split(),
    "female latin": "Ada Agnes Alice Anna Bertha Clara Diana Elena Emma Eva Flora Greta Hanna Ida Irene Julia Laura Lena Maria Marta Nora Olga Rosa Vera".split(),
    "surname latin": "Abel Baker Berger Blanc Brown Castro Cole Cruz Dumas Evans Ferrer Fischer Garnier Gomez Hall Hart Keller Lange Leroy Lopez Marin Meyer Moreau Nunez Parker Petit Ramos Richter Rivera Roux Sommer Torres Vidal Vogel Walker Weber Winter Wolf Young Ziegler".split(),
    "male cyrillic": "Андрей Борис Виктор Григорий Денис Егор Иван Кирилл Максим Николай Олег Павел".split(),
    "female cyrillic": "Алла Вера Галина Дарья Елена Жанна Ирина Клара Лариса Мария Нина Ольга".split(),
    "surname cyrillic": "Белов Волков Громов Дроздов Жуков Зимин Котов Лебедев Морозов Орлов Попов Рыбаков Соколов Титов Чернов".split(),
}


def _kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _parts(mention: Column, kind: Column) -> Column:
    """``kind, head, body, tail`` of what is replaced in a mention; head and
    tail stay. A name has one or two parts."""

    def part(k: Column | str, head: Column | str, body: Column, tail: Column | str) -> Column:
        lit = lambda c: F.lit(c) if isinstance(c, str) else c
        return F.struct(lit(k).alias("kind"), lit(head).alias("head"), body.alias("body"), lit(tail).alias("tail"))

    def split(pattern: str, k: Column | str = kind, tail: int | None = None) -> Column:
        return F.array(part(k, F.regexp_extract(mention, pattern, 1), F.regexp_extract(mention, pattern, 2), F.regexp_extract(mention, pattern, tail) if tail else ""))

    title = F.regexp_extract(mention, f"^({_TITLE}\\.? )", 1)
    script = F.when(mention.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(mention.rlike("^(?:" + "|".join(_TITLES_FEMALE) + ")\\b"), "female").otherwise("male")
    given = F.regexp_extract(mention, f"^{_TITLE}\\.? ({_NAME}) {_NAME}$", 1)
    surname = F.regexp_extract(mention, f"({_NAME})$", 1)
    family = part(F.concat(F.lit("surname "), script), F.when(given == "", title).otherwise(" "), surname, "")
    named = F.when(given == "", F.array(family)).otherwise(F.array(part(F.concat_ws(" ", gender, script), title, given, ""), family))
    return (
        F.when(kind == "name", named)
        .when(kind == "email", split(r"^()(.*)(\.[A-Za-z]+)$", tail=3))
        .when((kind == "phone") & mention.startswith("+"), split(r"^(\+[0-9]{1,3}(?![0-9])|\+[0-9])(.*)$"))
        .when(kind == "key", split(r"^(.{4})(.*)$"))
        .when(kind == "password", split(r"^([A-Za-z]+ ?[=:] ?[\"']?)(.*)$"))
        .otherwise(F.array(part(kind, "", mention, "")))
    )


def _canonical(kind: Column, body: Column) -> Column:
    return F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(body, "[^0-9]", "")).otherwise(F.lower(body))


def _draw(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """A surrogate of the same type and format as a canonical form."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    # As many random bytes as characters are needed, two hexadecimal digits each.
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.length(canonical).cast("int")), lambda i: F.when(i % 60 == 0, F.sha2(F.concat_ws("|", seed, i.cast("string")), 512)).otherwise("")), "")
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(stream, i, 1)) - 1
    byte = lambda i: digit(2 * i + 1) * 16 + digit(2 * i + 2)
    two = lambda i: byte(2 * i) * 256 + byte(2 * i + 1)

    def letter(c: Column, i: Column) -> Column:
        letters = F.when(kind == "hex", F.lit("abcdef")).otherwise(F.lit("abcdefghijklmnopqrstuvwxyz"))
        return (
            F.when(c.rlike("^[0-9]$"), F.substring(F.lit("0123456789"), (byte(i) % 10 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("^[a-z]$"), F.substring(letters, (byte(i) % F.length(letters) + 1).cast("int"), F.lit(1)))
            .otherwise(c)
        )

    scrambled = F.array_join(F.transform(F.split(canonical, ""), letter), "")
    octets = F.concat_ws(".", *[((byte(F.lit(i)) % 254) + 1).cast("int").cast("string") for i in range(4)])
    out = F.when(kind == "ip", octets)
    for k, names in NAMES.items():
        listed = F.array(*[F.lit(n) for n in names])
        # Later draws join more names, so there is always one that is free.
        several = F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(20))), lambda i: F.element_at(listed, (two(i) % len(names) + 1).cast("int")))
        out = out.when(kind == k, F.array_join(several, "-"))
    return out.otherwise(scrambled)


def _pour(kind: Column, body: Column, surrogate: Column) -> Column:
    """The surrogate in the format and case of a mention."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(done: Column, c: Column) -> Column:
        takes = ~kind.isin("phone", "ssn", "card") | c.rlike("^[0-9]$")
        new = F.substring(surrogate, done["at"], F.lit(1))
        new = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)
        return F.struct(F.concat(done["out"], F.when(takes, new).otherwise(c)).alias("out"), (done["at"] + F.when(takes, 1).otherwise(0)).alias("at"))

    whole = kind.isin("ip", *NAMES)
    return F.when(whole, surrogate).otherwise(F.aggregate(F.split(body, ""), start, step)["out"])


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for distinct ``kind, canonical``: no
    surrogate twice in a kind, none that is an entity itself."""
    table = materialise(entities.withColumn("attempt", F.lit(0)), "entities")
    while True:
        drawn = materialise(table.withColumn("surrogate", _draw(F.col("kind"), F.col("canonical"), F.col("attempt"), key)), "drawn")
        form = F.when(F.col("kind").isin(*NAMES), F.lower("surrogate")).otherwise(F.col("surrogate"))
        drawn = drawn.withColumn("form", form)
        # The first of those that drew the same keeps it, unless it is an entity.
        first = drawn.groupBy("kind", "form").agg(F.min("canonical").alias("keeper"))
        real = drawn.select("kind", F.col("canonical").alias("form"), F.lit(True).alias("real"))
        judged = drawn.join(first, ["kind", "form"]).join(real, ["kind", "form"], "left")
        judged = judged.withColumn("again", F.col("real").isNotNull() | (F.col("canonical") != F.col("keeper")))
        judged = materialise(judged.select("kind", "canonical", "surrogate", "attempt", "again"), "judged")
        if not judged.filter("again").limit(1).count():
            return judged.select("kind", "canonical", "surrogate")
        table = judged.select("kind", "canonical", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text column and ``n_replaced`` added."""
    found = F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0))
    named = docs.select(F.xxhash64(F.col(doc_id).cast("string")).alias("doc"), text_key(text).alias("_k"), F.col(text).alias("text"))
    mentions = materialise(named.select("doc", "_k", F.explode(F.array_distinct(found)).alias("mention")).distinct(), "mentions")
    parts = mentions.select("mention").distinct().withColumn("of", _kind(F.col("mention")))
    parts = parts.select("mention", F.posexplode(_parts(F.col("mention"), F.col("of"))).alias("i", "p")).select("mention", "i", "p.*")
    parts = materialise(parts.withColumn("canonical", _canonical(F.col("kind"), F.col("body"))), "parts")
    table = surrogate_table(parts.select("kind", "canonical").distinct(), key)
    poured = parts.join(table, ["kind", "canonical"]).withColumn("bare", F.concat(_pour(F.col("kind"), F.col("body"), F.col("surrogate")), "tail"))
    poured = poured.withColumn("new", F.concat("head", "bare"))
    whole = poured.groupBy("mention").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), "").alias("new"))
    # What a document may say without the title: the surname, or both names.
    names = poured.filter(F.col("kind").isin(*NAMES)).groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("i", "body", "bare"))).alias("p"))
    ending = lambda n: F.slice("p", -n, n)
    form = lambda n: F.struct(F.array_join(ending(n)["body"], " ").alias("form"), F.array_join(ending(n)["bare"], " ").alias("new"))
    forms = names.select("mention", F.explode(F.when(F.size("p") > 1, F.array(form(1), form(2))).otherwise(F.array(form(1)))).alias("f"))
    untitled = mentions.join(forms, "mention").select("doc", "_k", F.col("f.form").alias("mention"), F.col("f.new").alias("new"), F.lit(True).alias("untitled"))
    said = mentions.join(whole, "mention").select("doc", "_k", "mention", "new", F.lit(False).alias("untitled")).unionByName(untitled)
    said = said.groupBy("doc", "_k", "mention").agg(F.min("new").alias("new"), F.max("untitled").alias("untitled"))
    longest_first = F.reverse(F.sort_array(F.collect_list(F.when(F.col("untitled"), F.struct(F.length("mention").alias("n"), "mention")))))
    per_doc = said.groupBy(F.col("doc").alias("__llm_doc"), F.col("_k").alias("__llm_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("__llm_new"),
        F.array_join(F.transform(longest_first, lambda x: x["mention"]), "|").alias("__llm_names"),
    )
    joined = docs.withColumns({"__llm_doc": F.xxhash64(F.col(doc_id).cast("string")), "__llm_key": text_key(text)}).join(per_doc, ["__llm_doc", "__llm_key"], "left")
    untitled = F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), F.col("__llm_names"), F.lit(r")(?!\p{L})"))
    joined = joined.withColumn("__llm_entity", F.when(F.col("__llm_names") != "", untitled).otherwise(ENTITY))
    own, new = F.regexp_extract_all(F.col(text), F.col("__llm_entity"), F.lit(0)), F.col("__llm_new")
    between = F.split(F.col(text), F.col("__llm_entity"), -1)
    glued = F.array_join(F.transform(F.arrays_zip(between.alias("a"), own.alias("b")), lambda x: F.concat(x["a"], F.coalesce(F.element_at(new, x["b"]), F.lit("")))), "")
    done = joined.withColumn("__llm_n", F.when(new.isNull(), 0).otherwise(F.size(own)))
    done = done.withColumn(text, F.when(new.isNull(), F.col(text)).otherwise(glued))
    return done.select(*carried(docs, ["n_replaced"]), F.col("__llm_n").alias("n_replaced"))
