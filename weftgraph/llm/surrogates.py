"""PII surrogates, in DataFrame functions only: detected entities get keyed replacements of their own type, gender, script and format.

An entity's replacement follows from a keyed digest of its type and canonical form, so it is the same wherever the entity stands,
in the format of each place. Entities that share a part go on sharing it: family names, given names and mail domains are drawn by
themselves and put together, so "Frau Weber" is still the family of "Dr. Anna Weber", and colleagues keep one domain.

Digits become digits, letters letters of their case and script; card numbers and IBANs that pass their check go on passing it. Names
come from lists by gender and script; the gender is the title's, else that of the given name. Replacements are then checked over the
whole corpus, part by part: where two forms would share one, or one is itself an entity of the corpus, all but the first by digest are
drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise

#: A word that names a secret, = or :, and the value in quotes or not. Password and the like give away any value of six characters;
#: a bare token or key only quoted ones or runs of eight with a digit, as prose and code use these words too.
_SAYS = r"[\"']?[ \t]*(?::=|=>|[=:])[ \t]*"
SECRET = (
    r"\bAKIA[0-9A-Z]{16}\b"
    r"|(?i:password|passwd|passphrase|(?<![A-Za-z0-9])(?:pwd|secret|(?:api|secret|access|private|auth)[_-]?(?:key|token)))" + _SAYS + r"(?:\"[^\"\r\n]{6,}\"|'[^'\r\n]{6,}'|[\"']?[^\s\"']{6,})"
    r"|(?i:(?<![A-Za-z0-9])(?:token|key))" + _SAYS + r"(?:\"[^\"\s]{8,}\"|'[^'\s]{8,}'|(?=[^\s\"']*[0-9])[A-Za-z0-9_.~+/=-]{8,}+(?!@))"
)

#: Type -> Java regular expression, in order of preference. Groups don't capture.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": SECRET,
    "iban": r"\b[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]*?\d){6})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b\d{4}(?:[ -]?\d{4}){3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}\b|\+\d{1,3}(?:[ .-]\d{2,5}){2,5}\b|\b\d{3}-\d{3}-\d{4}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# Titles by gender (n: they don't say), given names by gender and script, and the names that surrogates are made of.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"],
    "m": ["Mr", "Herr", "Señor", "Monsieur", "Господин"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    "f": """Alice Amélie Anna Barbara Carmen Charlotte Chloé Claire Claudia Elena Elizabeth Emily Emma Eva Franziska Hannah Ines Ingrid Isabel Jane
        Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Louise Lucía Margaret Maria María Marie Martha Mary Monika Nancy Olivia Patricia Petra
        Sabine Sandra Sarah Sofia Sophie Susan Susanne Ursula Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна""".split(),
    "m": """Alejandro Andreas Antoine Antonio Benjamin Carlos Charles Christian Daniel David Diego Edward Felix Fernando François Frank George Hans
        Heinrich Henry Jack Jacques James Javier Jean John Jonas José Juan Julien Jürgen Karl Klaus Lukas Manuel Mark Martin Matthew Michael
        Miguel Oliver Paul Pedro Peter Philippe Pierre Richard Robert Stefan Steven Thomas William Wolfgang Александр Андрей Владимир Дмитрий Иван Михаил Николай Сергей""".split(),
}
NAMES = {
    "latin f": ["Adele", "Clara", "Edith", "Greta", "Hedda", "Ida", "Lena", "Nora", "Paula", "Rosa", "Sara", "Vera"],
    "latin m": ["Adam", "Bruno", "Erik", "Hugo", "Jakob", "Leon", "Max", "Oscar", "Otto", "Simon", "Theo", "Viktor"],
    "latin n": ["Alex", "Charlie", "Chris", "Jamie", "Kim", "Nico", "Robin", "Sam"],
    "cyrillic f": ["Вера", "Дарья", "Зоя", "Лидия", "Нина", "Софья", "Тамара", "Юлия"],
    "cyrillic m": ["Антон", "Борис", "Глеб", "Игорь", "Олег", "Павел", "Роман", "Юрий"],
    "cyrillic n": ["Валя", "Женя", "Саша", "Шура"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fer", "gan", "hol", "ker", "lin", "mar", "nor", "pel", "ran", "sto", "tam", "ver", "wil", "zan"],
    "cyrillic": ["ба", "дел", "жур", "зан", "ков", "лин", "мар", "нов", "пет", "ран", "сер", "тим", "фед", "хол", "цар", "щер"],
}


# Letters by script, capitals second; other scripts' letters become Latin ones.
LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя",
    "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[Α-ΩΆ-Ώ]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "\\p{IsHan}": "一二三四五六七八九十日月火水木金土山川田人口手目耳心力大小中上下左右東西南北",
    "\\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "\\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
#: Symbols that stand in for those of a secret; the ones that part its pieces stay, unless there is little else in it.
SYMBOLS, PARTING = "!#$%&*+?^~", "[-_./+=:,@ \t]"

_WORD = r"\p{Lu}[\p{Ll}'’-]+"


def _any_of(words: list[str]) -> str:
    """A pattern of the words, parted by first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ")"


#: A title and one to three names, or a known given name and one or two more.
TITLED = rf"(?<!\p{{L}})(?=\p{{Lu}}){_any_of([t for own in TITLES.values() for t in own])}\.? (?:{_WORD} ){{0,2}}{_WORD}"
UNTITLED = rf"(?<!\p{{L}})(?=\p{{Lu}}){_any_of([g for own in GIVEN.values() for g in own])} (?:{_WORD} )?{_WORD}"
PATTERNS["name"] = f"{TITLED}|{UNTITLED}"
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Rounds of drawing; what still clashes then (there are but so many IP addresses of one-digit parts) gets a tail of its own.
ROUNDS = 12
#: An entity in more rows than this, or in over 1/10,000 of all, is joined by broadcast: there are at most 10,000 such.
HOT_ROWS, HOT_SHARE = 100_000, 10_000
#: The key of the registered query, unless the session names one in spark.weftgraph.surrogateKey.
QUERY_KEY = "not a secret: the registered query's key"


def entity_type(entity: Column) -> Column:
    """The first type whose pattern is the whole entity."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _number(digest: Column, place: Column | int) -> Column:
    """0 .. 65535 from the digest (hex), by place; digests are 4 * 64 hex digits long and go round."""
    at = (F.lit(place) if isinstance(place, int) else place) % 64 * 4 + 1
    return F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int")


def _pick(options: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), n % len(options))


def _picker(options: list[str], digest: Column):
    return lambda i: _pick(options, _number(digest, i))


def _char(options: str, n: Column) -> Column:
    return F.substring(F.lit(options), n % len(options) + 1, F.lit(1))


def _like(text: Column, digest: Column, secret: bool = False) -> Column:
    """`text` with digits as digits and letters as letters of their case and script; hex words stay hex; first digits other than 0 stay
    so. In a secret symbols are replaced too, but for those that part pieces of at least four letters or digits in all."""
    chars = F.split(text, "")
    hexes = text.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")
    shown = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")) >= 4

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        digit = F.when((i == 0) & (c != "0"), 1 + n % 9).otherwise(n % 10).cast("string")
        out = F.when(c.rlike("[0-9]"), digit).when(hexes & c.rlike("[a-z]"), _char("abcdef", n)).when(hexes, _char("ABCDEF", n))
        for pattern, options in LETTERS.items():
            out = out.when(c.rlike(pattern), _char(options, n))
        if secret:
            out = out.when(c.rlike(r"\p{Nd}"), digit).when(c.rlike(r"\s") | (c.rlike(PARTING) & shown), c).otherwise(_char(SYMBOLS, n))
        return out if secret else out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's rule over a string of digits."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The remainder that IBANs are checked by: the first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + letter) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _digest(key: str, *of: Column) -> Column:
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(f"{key} {k}"), *of), 256) for k in range(4)])


#: What stands before the value of a secret, and the country code of a phone number.
_HEAD = r"^(AKIA|[^=:]+(?::=|=>|[=:])[ \t]*[\"']?)"
_COUNTRY = r"^(\+\d{1,3})[ .(-]"
_TITLE = rf"^({_any_of([t for own in TITLES.values() for t in own])})(?:\.? |$)"


def _after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def canonical(kind: Column, entity: Column) -> Column:
    """The form that all spellings of an entity share: mailboxes in lower case, numbers without separators (a country code stays
    apart), IBANs without spaces, the bare value of a secret, names without the title's dot."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    country = F.regexp_extract(entity, _COUNTRY, 1)
    phone = F.concat(country, F.lit(" "), F.regexp_replace(_after(entity, country), "[^0-9]", ""))
    head = F.regexp_extract(entity, _HEAD, 1)
    secret = F.when(head == "AKIA", entity).otherwise(F.regexp_replace(_after(entity, head), "[\"']$", ""))
    title = F.regexp_extract(entity, _TITLE, 1)
    out = F.when(title != "", F.concat(title, F.regexp_replace(_after(entity, title), r"^\.", ""))).otherwise(entity)
    for label, value in (("email", F.lower(entity)), ("secret", secret), ("iban", F.replace(entity, F.lit(" "), F.lit(""))), ("card", digits), ("ssn", digits), ("phone", phone), ("ip", entity)):
        out = F.when(kind == label, value).otherwise(out)
    return out


def _fill(text: Column, drawn: Column) -> Column:
    """`text` with its ASCII letters and digits replaced by the characters of `drawn` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(a: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(a["out"], F.when(own, F.substring(drawn, a["at"], F.lit(1))).otherwise(c)).alias("out"), (a["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(text, ""), start, one, lambda a: a["out"])


def rendered(kind: Column, entity: Column, drawn: Column) -> Column:
    """The replacement `drawn` of the canonical form, in the format of the entity."""
    email = F.array_join(F.zip_with(F.split(entity, ""), F.split(drawn, ""), lambda c, x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(F.coalesce(x, F.lit("")))), "")
    head = F.regexp_extract(entity, _HEAD, 1)
    secret = F.when(head == "AKIA", drawn).otherwise(F.concat(head, drawn, F.regexp_extract(_after(entity, head), "([\"']?)$", 1)))
    country = F.regexp_extract(entity, _COUNTRY, 1)
    phone = F.concat(country, _fill(_after(entity, country), _after(drawn, F.concat(country, F.lit(" ")))))
    title = F.regexp_extract(entity, _TITLE, 1)
    dotted = F.when((title != "") & (F.substring(_after(entity, title), 1, 1) == "."), F.concat(title, F.lit("."), _after(drawn, title))).otherwise(drawn)
    out = dotted
    for label, value in (("email", email), ("secret", secret), ("iban", _fill(entity, drawn)), ("card", _fill(entity, drawn)), ("ssn", _fill(entity, drawn)), ("phone", phone), ("ip", drawn)):
        out = F.when(kind == label, value).otherwise(out)
    return out


def _cyrillic(text: Column) -> Column:
    return text.rlike(r"\p{IsCyrillic}")


def part_surrogate(kind: Column, part: Column, attempt: Column, key: str) -> Column:
    """What a family name, a given name (after its gender and a space) or a mail domain becomes at an attempt (0, 1, ...)."""
    own = _digest(key, kind, part, attempt.cast("string"))
    more = F.greatest(attempt - 2, F.lit(0))  # after some clashes there are too few of a length
    syllables = F.when(_cyrillic(part), F.array(*map(F.lit, SYLLABLES["cyrillic"]))).otherwise(F.array(*map(F.lit, SYLLABLES["latin"])))
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), 3 + more), lambda i: F.get(syllables, _number(own, i) % 16)), ""))
    gender, given = F.substring_index(part, " ", 1), F.expr("null")
    for label, names in NAMES.items():
        script, g = label.split()
        several = F.array_join(F.transform(F.sequence(F.lit(0), attempt), _picker(names, own)), "-")
        given = F.when((gender == g) & (_cyrillic(part) == F.lit(script == "cyrillic")), several).otherwise(given)
    host, top = F.regexp_extract(part, r"^(.*)\.[^.]+$", 1), F.substring_index(part, ".", -1)
    domain = F.concat(_like(host, own), F.substring(own, F.lit(1), more), F.lit("."), top)
    return F.when(kind == "family", family).when(kind == "given", given).otherwise(domain)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The replacement, canonical too, that an entity in canonical form gets at an attempt (0, 1, ...); of a mailbox the part before @."""
    own = _digest(key, kind, entity, attempt.cast("string"))
    more = F.greatest(attempt - 2, F.lit(0))
    local = F.concat(_like(F.substring_index(entity, "@", 1), own), F.substring(own, F.lit(1), more))
    drawn = _like(entity, own)
    base = F.concat(F.substring(drawn, F.lit(1), F.length(entity) - 1), F.lit("0"))
    check = F.when(_luhn(entity) % 10 == 0, ((10 - _luhn(base) % 10) % 10).cast("string")).otherwise(F.substring(drawn, -1, 1))
    card = F.concat(F.substring(drawn, F.lit(1), F.length(entity) - 1), check)

    def octet(part: Column, i: Column) -> Column:
        n, size = _number(own, i), F.length(part)
        return F.when(size == 1, 1 + n % 9).when(size == 2, 10 + n % 90).otherwise(100 + n % 155).cast("string")

    ip = F.array_join(F.transform(F.split(entity, r"\."), octet), ".")
    secret = F.when(entity.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), _like(F.substring(entity, F.lit(5), F.length(entity)), own))).otherwise(_like(entity, own, secret=True))
    country, account = F.substring(entity, 1, 2), _like(F.substring(entity, F.lit(5), F.length(entity)), own)
    digits = F.when(_mod97(entity) == 1, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")).otherwise(_like(F.substring(entity, 3, 2), _digest(key, F.lit("check"), entity)))
    iban = F.concat(country, digits, account)
    head = F.concat(F.regexp_extract(entity, r"^(\+\d{1,3}) ", 1), F.lit(" "))
    phone = F.concat(head, _like(_after(entity, head), own))
    out = drawn
    for label, value in (("email", local), ("secret", secret), ("iban", iban), ("card", card), ("phone", phone), ("ip", ip)):
        out = F.when(kind == label, value).otherwise(out)
    return out


def _tail(key: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(key), F.col("canon")), 256), 1, 16)


def _drawn(real: DataFrame, draw: Column, whole: Column, key: str, free: tuple[str, ...] = ()) -> DataFrame:
    """(real's columns, surrogate): `draw` at attempts that give each (kind, canon) a `whole` of its own, which is no canon of the kind;
    kinds in `free` may become each other's. Each round is written to the shared folder."""
    draw = draw.alias("surrogate")
    now = materialise(real.withColumn("attempt", F.lit(0)).select("*", draw).withColumn("tail", F.lit("")), "surrogates")
    known = now.where(~F.col("kind").isin(*free) if free else F.lit(True)).select("kind", F.col("canon").alias("whole"), F.lit(True).alias("taken"))
    for rounds in range(1, ROUNDS + 2):
        # two windows of small groups: those of one surrogate
        taken = now.withColumn("whole", whole).join(known, ["kind", "whole"], "left")
        order = Window.partitionBy("kind", "whole", "tail").orderBy("attempt", F.sha2(F.concat(F.lit(key), F.col("canon")), 256))
        bad = (F.col("taken").isNotNull() & (F.col("tail") == "")) | (F.row_number().over(order) > 1)
        judged = materialise(taken.withColumn("bad", bad).drop("taken", "whole"), "judged")
        if judged.where("bad").isEmpty():
            now = judged
            break
        judged = judged.withColumn("attempt", F.when(F.col("bad"), rounds).otherwise(F.col("attempt")))
        judged = judged.withColumn("surrogate", F.when(F.col("bad"), draw).otherwise(F.col("surrogate")))
        if rounds > ROUNDS:
            judged = judged.withColumn("tail", F.when(F.col("bad"), _tail(key)).otherwise(F.col("tail")))
        now = materialise(judged.select(*real.columns, "attempt", "surrogate", "tail"), "surrogates")
    return now.select(*real.columns, "surrogate", "tail")


def _with_names(every: DataFrame) -> DataFrame:
    """Entities with the parts of names and mailboxes: title, family, given (gender and name; null without one), domain."""
    title = F.regexp_extract("canon", _TITLE, 1)
    words = F.split(F.trim(F.when(title != "", _after(F.col("canon"), title)).otherwise(F.col("canon"))), " ")
    said, name = F.lit("n"), F.get(words, F.lit(0))
    for g in "mf":
        said = F.when(name.isin(GIVEN[g]), g).otherwise(said)
    for g in "mf":
        said = F.when(title.isin(TITLES[g]), g).otherwise(said)
    is_name = F.col("kind") == "name"
    given = F.when(is_name & (F.size(words) > 1), F.concat(said, F.lit(" "), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")))
    return every.select(
        "*", F.when(is_name, title).alias("title"), F.when(is_name, F.element_at(words, -1)).alias("family"), given.alias("given"),
        F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1)).alias("domain"),
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (entity): spellings of one canonical form share a surrogate, each in its own format; no
    two forms of a kind share one, and none is an entity of the corpus (a given name can be that of somebody else).

    Forms that clash are drawn again until none do. A kind of few forms (an IP of one-digit parts, say) could run out: after ROUNDS
    rounds its rows get a tail instead, which keeps them distinct.
    """
    kind = entity_type(F.col("entity"))
    every = entities.select("entity", kind.alias("kind")).withColumn("canon", canonical(F.col("kind"), F.col("entity")))
    every = materialise(_with_names(every), "entities")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("canon")) for k in ("family", "given", "domain")])).alias("part")
    parts = every.select(kinds).select("part.*").where("canon is not null").distinct()
    parts = _drawn(parts, part_surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key), F.col("surrogate"), key, free=("given",))
    parts = materialise(parts.select("kind", "canon", F.concat("surrogate", "tail").alias("part")), "parts")

    def of(kind: str) -> DataFrame:
        return parts.where(F.col("kind") == kind).select(F.col("canon").alias(kind), F.col("part").alias(f"new_{kind}"))

    real = every.where("kind <> 'name'").select("kind", "canon", "domain").distinct().join(of("domain"), "domain", "left").drop("domain")
    whole = F.when(F.col("kind") == "email", F.concat_ws("@", "surrogate", "new_domain")).otherwise(F.col("surrogate"))
    drawn = _drawn(real, surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key), whole, key)
    drawn = drawn.select("kind", "canon", F.when(F.col("kind") == "email", F.concat("surrogate", "tail", F.lit("@"), "new_domain")).otherwise(F.concat("surrogate", "tail")).alias("new"))
    others = every.where("kind <> 'name'").join(drawn, ["kind", "canon"])
    names = every.where("kind = 'name'").join(of("family"), "family").join(of("given"), "given", "left")
    names = names.withColumn("new", F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), "new_given", "new_family"))
    done = others.select("kind", "entity", "new").unionByName(names.select("kind", "entity", "new"))
    return materialise(done.select("kind", "entity", rendered(F.col("kind"), F.col("entity"), F.col("new")).alias("surrogate")), "table")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, n_entities): the texts with every detected entity replaced, and how many there were. Whoever has the `key`
    can draw the same surrogates again.

    - Entities of one canonical form get one surrogate in all texts, different ones different; what is not an entity stays as it is.
    - A null text stays null, with 0 entities; an empty one stays empty. Texts are searched whole.
    - Null and repeated ids and rows are kept, each row by itself. Columns other than the two named don't matter. No rows give none.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # one search of each text: what it finds is written beside the texts, so that nothing is searched again to tell the plain ones
    found = F.coalesce(F.regexp_extract_all("text", F.lit(EVERY), 0), F.array().cast("array<string>"))
    searched = materialise(src.select("id", "text", found.alias("found"), F.xxhash64("text").alias("print")), "found")
    hits, plain = searched.where("size(found) > 0"), searched.where("size(found) = 0").select("id", "text", F.lit(0).cast("long").alias("n_entities"))
    each = hits.select("id", "print", F.explode(F.array_distinct("found")).alias("entity")).distinct()
    counts = materialise(each.groupBy("entity").agg(F.count("*").alias("n")), "counts")
    table = surrogate_table(counts.select("entity"), key).select("entity", "surrogate")
    # entities in many rows don't go to one task: those that are few by HOT_SHARE are broadcast, the others are joined by a shuffle
    most = F.greatest(F.lit(HOT_ROWS), F.lit((counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE))
    hot = counts.where(F.col("n") > most).select("entity")
    if hot.isEmpty():
        met = each.join(table, "entity")
    else:
        hot = F.broadcast(materialise(table.join(hot, "entity", "left_semi"), "hot").withColumnRenamed("surrogate", "known"))
        split = each.join(hot, "entity", "left")
        met = split.where("known is null").drop("known").join(table, "entity").unionByName(split.where("known is not null").withColumnRenamed("known", "surrogate"))
    maps = met.groupBy("id", "print").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("map"))
    left, right = hits.alias("l"), maps.alias("r")
    met = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.print") == F.col("r.print"))).select("l.id", "text", "found", "map")
    met = met.withColumn("pieces", F.split("text", EVERY, -1))
    text = F.array_join(F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.element_at("map", F.get("found", i)), F.lit("")))), "")
    done = met.select("id", text.alias("text"), F.size("found").cast("long").alias("n_entities"))
    return plain.unionByName(done).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")


def op1_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get("spark.weftgraph.surrogateKey", QUERY_KEY))
