"""Personal data replaced by surrogates: the same for the same entity everywhere, different for different ones.

A surrogate follows from a secret key, the entity's type and its text; it keeps type and format, and of names the
gender, the script and the case. All entities of the corpus are named in one table, in which no two share a
surrogate and none has that of a real entity: whoever collides takes the next attempt.

A person is found behind a title. Where a document has one, the capitalised words of that document that are its given or family name, in any
later or earlier place and without a title, take the same surrogate; if a word is both, the family's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.llm.common import KEY, row_key, text_of

# fixed values: titles that tell a gender, and titles that do not
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof")
#: Syllables of made-up names, by script, and their last ones by gender.
SYLLABLES = {
    "latin": ("ba be da do fe ga ka ko la le li lo ma me mi na ne no pa ra re ri ro sa se ta te ti va ve", "n", "ra", "l"),
    "cyrillic": ("ба бе да до га ка ко ла ле ли ло ма ме ми на не но па ра ре ри ро са се та те ти ва ве", "н", "на", "р"),
    "greek": ("βα βε δα δο γα κα κο λα λε λι λο μα με μι να νε νο πα ρα ρε ρι ρο σα σε τα τε τι φα φε", "ν", "να", "ρ"),
}
_TITLE = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?"
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    ("ip6", rf"(?<![0-9A-Fa-f:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|[Ff][Ee]80:(?::{_HEX}){{1,5}})(?![0-9A-Fa-f:])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])(?:\d{4}(?:[ -]?\d{4}){3}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\d-])"),
    ("phone", r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"),
    ("person", rf"(?<!\p{{L}}){_TITLE} {_NAME}(?: {_NAME})?"),
)
_ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A capitalised word, which may be a name of a person that the document names with a title.
_WORD = r"(?<!\p{L})\p{Lu}\p{L}{0,40}(?:['’-]\p{Lu}\p{L}{0,40})*"
_ANY_OR_WORD = f"{_ANY}|(?:{_WORD})"
_MAYBE = r"[0-9@]|" + _TITLE + " "
TYPES = tuple(t for t, _ in PATTERNS)
MAX_ATTEMPTS = 64


def entities(text: Column) -> Column:
    """All entities of a text, leftmost first, without overlap. A text without digit, @ or title is not searched."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _type(entity: Column) -> Column:
    out = F.when(entity.rlike(r"\A\p{Lu}[\p{L}'’-]*\z"), "word")
    for name, pattern in PATTERNS[:-1]:
        out = out.when(entity.rlike(rf"\A(?:{pattern})\z"), name)
    return out.otherwise("person")


def _parts(entity: Column, kind: Column) -> Column:
    """(before, type, entity as found): a name is two parts, its given and its family name, each with what stands before it."""
    w = F.split(entity, " ")
    title = F.rtrim(w[0], F.lit("."))
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")
    part = lambda b, t, e: F.struct(b.alias("before"), t.alias("type"), e.alias("said"))
    given = part(F.concat(w[0], F.lit(" ")), F.concat(F.lit("given-"), gender), F.get(w, 1))
    family = F.get(w, F.size(w) - 1)
    return (
        F.when(kind != "person", F.array(part(F.lit(""), kind, entity)))
        .when(F.size(w) > 2, F.array(given, part(F.lit(" "), F.lit("family"), family)))
        .otherwise(F.array(part(F.concat(w[0], F.lit(" ")), F.lit("family"), family)))
    )


def _stream(key: str) -> Column:
    """128 keyed bytes, in hexadecimal digits."""
    said = [F.lit(key), F.col("type"), F.col("entity"), F.col("attempt").cast("string")]
    return F.concat(*[F.sha2(F.concat_ws("\x1f", *said, F.lit(str(k))).cast("binary"), 256) for k in range(4)])


def _with_surrogate(df: DataFrame, key: str) -> DataFrame:
    """Adds the candidate for (type, entity, attempt)."""
    return df.withColumn("_stream", _stream(key)).withColumn("surrogate", _surrogate()).drop("_stream")


def _surrogate() -> Column:
    e, chars = F.col("entity"), F.split("entity", "")
    byte = lambda i: F.conv(F.substring("_stream", F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    letter = lambda alphabet, i: F.substring(F.lit(alphabet), F.pmod(byte(i), F.lit(len(alphabet))) + 1, F.lit(1))

    def shaped(c, i):
        return (
            F.when(c.between("0", "9"), letter("0123456789", i)).when(c.between("a", "z"), letter("abcdefghijklmnopqrstuvwxyz", i))
            .when(c.between("A", "Z"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c)
        )

    every = F.array_join(F.transform(chars, shaped), "")
    # the last label of a host and a country code stay
    last = F.regexp_extract(e, r"\.[a-z]+\z", 0)
    email = F.concat(F.substring(every, F.lit(1), F.length(e) - F.length(last)), last)
    code = F.regexp_extract(e, r"\A\+\d{1,3}", 0)
    phone = F.concat(code, F.substring(every, F.length(code) + 1, F.length(e)))
    ip = F.concat_ws(".", *[(F.pmod(byte(F.lit(j)), F.lit(254)) + 1).cast("string") for j in range(4)])
    host = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Fa-f]"), letter("0123456789abcdef", i)).otherwise(c)), "")
    # a card number that passes its check still does, and one that does not, does not
    digits = lambda s: F.transform(F.split(F.regexp_replace(s, r"\D", ""), ""), lambda d: d.cast("int"))

    def check(s):
        d = digits(s)
        odd = lambda x, i: F.when(F.pmod(F.size(d) - i, F.lit(2)) == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return F.pmod(F.aggregate(F.transform(d, odd), F.lit(0), lambda a, x: a + x), F.lit(10))

    fixed = F.pmod(F.right(every, F.lit(1)).cast("int") + check(e) - check(every), F.lit(10)).cast("string")
    card = F.concat(F.substring(every, F.lit(1), F.length(e) - 1), fixed)
    out = F.when(F.col("type") == "email", email).when(F.col("type") == "phone", phone).when(F.col("type") == "ip", ip).when(F.col("type") == "ip6", host).when(F.col("type") == "card", card).when(F.col("type") == "ssn", every)
    script = F.when(e.rlike(r"\A\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\A\p{IsGreek}"), "greek").otherwise("latin")
    for name, (inner, male, female, other) in SYLLABLES.items():
        s = F.split(F.lit(inner), " ")
        # a longer name for each sixteen attempts, so that names do not run out
        n = F.lit(2) + F.floor(F.col("attempt") / 4).cast("int")
        stem = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at(s, F.pmod(byte(i), F.lit(len(inner.split(" ")))) + 1)), "")
        end = F.when(F.col("type") == "given-m", male).when(F.col("type") == "given-f", female).otherwise(other)
        out = out.when(script == name, F.concat(stem, end))
    return out


def _canonical(said: Column, kind: Column) -> Column:
    """What makes two mentions the same: e-mail addresses and names whatever their case; cards and telephones as written."""
    return F.when(kind.isin("email", "ip6", "family", "word") | kind.like("given%"), F.lower(said)).otherwise(said)


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate) for the different (type, entity) of ``found``: no two of a type share a surrogate, none is an entity of
    that type. Of those that collide the one with the fewest attempts (then the first) keeps it, the others try again."""
    known = staged(found.select("type", "entity").distinct(), "entities")
    state = staged(_with_surrogate(known.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(MAX_ATTEMPTS):
        first = state.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("_first"))
        real = known.select("type", F.col("entity").alias("surrogate"), F.lit(True).alias("_real"))
        judged = state.join(first, ["type", "surrogate"]).join(real, ["type", "surrogate"], "left")
        again = (F.col("_first.entity") != F.col("entity")) | F.col("_real").isNotNull()
        judged = staged(judged.select("type", "entity", "attempt", "surrogate", again.alias("_again")), "judged")
        if judged.where("_again").isEmpty():
            return state.drop("attempt")
        tried = _with_surrogate(judged.where("_again").select("type", "entity", (F.col("attempt") + 1).alias("attempt")), key)
        state = staged(judged.where("not _again").drop("_again").unionByName(tried), "surrogates")
    raise ValueError("entities of a type outnumber its surrogates")


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, text) for every row, with surrogates for entities. Null and empty texts are ''; repeated rows give
    the same text. Texts without entities pass through as they are and are not shuffled."""
    text = text_of()
    base = docs.select("doc_id", *row_key(), text.alias("_t")).withColumn("_e", entities(F.col("_t")))
    has = F.size("_e") > 0
    # only documents with a person are searched for words
    titled = F.exists("_e", lambda x: x.rlike(rf"\A{_TITLE} "))
    found = F.when(titled, F.regexp_extract_all("_t", F.lit(_ANY_OR_WORD), F.lit(0))).otherwise(F.col("_e"))
    mentions = staged(
        base.where(has).select(*KEY, F.posexplode(found).alias("_pos", "_m")).distinct()
        .select(*KEY, "_pos", F.posexplode(_parts(F.col("_m"), _type(F.col("_m")))).alias("_sub", "_p")).select(*KEY, "_pos", "_sub", "_p.*")
        .withColumn("entity", _canonical(F.col("said"), F.col("type"))),
        "mentions",
    )
    plain = F.col("type").like("given%") | (F.col("type") == "family")
    known = mentions.where(F.col("type") != "word")
    names = known.where(plain).groupBy(*KEY, "entity").agg(F.min("type").alias("_as"))
    words = staged(mentions.where(F.col("type") == "word").join(names, [*KEY, "entity"], "left"), "words")
    again = words.where(F.col("_as").isNotNull()).withColumn("type", F.col("_as")).select(*known.columns)
    table = surrogates(known, key)
    cased = (
        F.when(plain & (F.col("said") == F.upper("said")), F.upper("surrogate")).when(plain, F.initcap("surrogate"))
        .when((F.col("type") == "email") & (F.col("said") == F.upper("said")), F.upper("surrogate")).otherwise(F.col("surrogate"))
    )
    one = known.unionByName(again).join(table, ["type", "entity"]).select(*KEY, "_pos", "_sub", F.concat("before", cased).alias("_new"), F.lit(True).alias("_is"))
    # words that are no names stay
    one = one.unionByName(words.where(F.col("_as").isNull()).select(*KEY, "_pos", "_sub", F.col("said").alias("_new"), F.lit(False).alias("_is")))
    # the parts of a mention, then the mentions of a document, in order: no more than the text itself has
    lists = one.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_pos", "_sub", "_new", "_is"))).alias("_n"))
    # a mention has one part or two; the second is put behind the first
    after = lambda x, i: F.when(F.get("_n", i + 1)["_pos"] == x["_pos"], F.get("_n", i + 1)["_new"]).otherwise("")
    whole = F.transform("_n", lambda x, i: F.struct(x["_sub"].alias("sub"), F.concat(x["_new"], after(x, i)).alias("new"), x["_is"].alias("is")))
    lists = lists.select(*KEY, F.filter(whole, lambda x: x["sub"] == 0).alias("_n"))
    joined = base.where(has).join(lists, KEY)
    between = F.when(titled, F.split("_t", _ANY_OR_WORD, -1)).otherwise(F.split("_t", _ANY, -1))
    new = F.concat(F.transform("_n", lambda x: x["new"]), F.array(F.lit("")))
    replaced = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    n = F.size(F.filter("_n", lambda x: x["is"])).cast("long")
    changed = joined.select("doc_id", n.alias("n_entities"), replaced.alias("text"))
    same = base.where(~has).select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.col("_t").alias("text"))
    return changed.unionByName(same)
