"""Matching people of two sources that share no key: a cascade of deterministic rules.

First the ids of one source that are one person are put together (exact contact, agreeing names, any chain of such
ties), so that the cascade works on persons. Each pass is an exact join on one attribute, weaker than the one before,
and holds rules that ask for less and less agreement of the names. Persons resolved by an earlier pass are anti-joined:
they meet no other resolved person again, but stay open to one that nobody has met yet, for a person may have several
ids on either side that nothing ties within its source, and no match is to be lost. A rule's confidence is its
precision on pairs with labels, smoothed. Pairs of persons are expanded by membership at the end.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.values import key_text
from tributary.llm.components import HOT_LEAST, components
from tributary.operators.skew import lookup_join
from tributary.session import saved, saved_rows

#: Letters with marks and what they are compared as.
MARKED = "àáâãäåāăąçćčďèéêëēěęìíîïīłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorssstuuuuuuuyyzzz"
#: Short forms of first names and the names they stand for.
SHORT_FORMS = {
    "abby": "abigail", "al": "albert alexander", "alec": "alexander", "alex": "alexander alexandra", "alf": "alfred", "andy": "andrew",
    "barb": "barbara", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bert": "albert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "bob": "robert", "carl": "carlos", "carrie": "caroline", "cath": "catherine", "cathy": "catherine katherine", "charlie": "charles",
    "chris": "christopher christina", "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard",
    "dot": "dorothy", "drew": "andrew", "ed": "edward eduardo", "eddie": "edward", "edu": "eduardo", "ellie": "eleanor", "etta": "henrietta", "fran": "frances",
    "fred": "frederick", "gabe": "gabriel", "gerry": "gerald", "greg": "gregory", "hal": "harold", "hank": "henry", "harry": "harold henry", "jake": "jacob",
    "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jo": "joanna josephine", "joe": "joseph", "johnny": "john",
    "jon": "jonathan", "josie": "josephine", "judy": "judith", "kate": "katherine", "kathy": "katherine", "ken": "kenneth", "larry": "laurence", "len": "leonard",
    "leo": "leonard", "liz": "elizabeth", "maggie": "margaret", "mandy": "amanda", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mike": "michael",
    "mina": "wilhelmina", "nat": "natalie", "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "pam": "pamela", "pat": "patricia patrick",
    "peg": "margaret", "peggy": "margaret", "pete": "peter", "pippa": "philippa", "rafa": "rafael", "ray": "raymond", "rob": "robert", "ron": "ronald", "ros": "rosalind",
    "sam": "samuel samantha", "sandy": "sandra alexander", "seb": "sebastian", "steve": "stephen", "sue": "susanna", "susie": "susanna", "ted": "edward theodore",
    "theo": "theodore", "tilda": "matilda", "tilly": "matilda", "tim": "timothy", "tina": "bettina christina", "tom": "thomas", "tony": "anthony", "trish": "patricia",
    "val": "valentina", "vic": "victor", "vicky": "victoria", "vince": "vincent", "walt": "walter", "will": "william", "zack": "zachary",
    "jorge": "george", "juan": "john", "jose": "joseph", "josef": "joseph", "joao": "john", "jean": "john", "hans": "john", "johann": "john",
    "giovanni": "john", "guillermo": "william", "guillaume": "william", "wilhelm": "william", "willem": "william", "carlo": "charles", "karl": "charles carlos",
    "pedro": "peter", "pierre": "peter", "pietro": "peter", "piotr": "peter", "miguel": "michael", "michel": "michael", "mikhail": "michael",
    "jakob": "jacob", "jacques": "james jacob", "jaime": "james", "diego": "james", "stefan": "stephen", "etienne": "stephen", "esteban": "stephen",
    "andreas": "andrew", "andre": "andrew", "andres": "andrew", "andrei": "andrew", "frederic": "frederick", "friedrich": "frederick", "federico": "frederick",
    "margarita": "margaret", "marguerite": "margaret", "margarete": "margaret", "isabel": "isabella elizabeth", "elisabeth": "elizabeth", "katharina": "katherine catherine",
    "catalina": "catherine", "catarina": "catherine", "ekaterina": "catherine katherine", "alejandro": "alexander", "aleksandr": "alexander", "alexandre": "alexander",
    "nicolas": "nicholas", "nikolaus": "nicholas", "nicola": "nicholas", "lorenzo": "laurence", "laurent": "laurence", "lorenz": "laurence",
    "helene": "helena", "elena": "helena", "ana": "hannah", "hanna": "hannah", "matthias": "matthew", "mateo": "matthew", "mathieu": "matthew", "matteo": "matthew",
    "anton": "anthony", "antonio": "anthony", "antoine": "anthony", "leonardo": "leonard", "leonhard": "leonard", "ricardo": "richard", "roberto": "robert",
    "tomas": "thomas", "tommaso": "thomas", "cristina": "christina", "christine": "christina", "kristina": "christina", "susanne": "susanna", "suzanne": "susanna",
    "georg": "george", "eduard": "edward eduardo", "edouard": "edward eduardo", "albrecht": "albert", "alberto": "albert", "benjamín": "benjamin", "sofie": "sofia", "sophie": "sofia",
}


def plain_name(c: Column) -> Column:
    """Lower case, no marks, no middle initials or punctuation but inner hyphens; null if nothing is left."""
    v = F.translate(F.lower(c), MARKED, PLAIN)
    v = F.regexp_replace(F.regexp_replace(v, "ß", "ss"), r"[^a-z\- ]+", " ")
    v = F.trim(F.regexp_replace(v, r"(?<=\w\w) [a-z](?= |$)|\s+", " "))
    return F.when(key_text(v).isNotNull(), v)


def phone_digits(c: Column) -> Column:
    """The last ten digits without an extension; null for fewer than seven or for one repeated digit."""
    d = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?:x|ext|#).*$", ""), r"\D", "")
    return F.when((F.length(d) >= 7) & ~d.rlike(r"^(\d)\1*$|^1234567"), F.substring(d, -10, 10))


def plain_email(c: Column) -> Column:
    """Lower case without blanks and without a +tag; null without an @."""
    v = F.regexp_replace(F.lower(c), r"\s+", "")
    return F.when(v.rlike(r"^[^@]+@[^@]+$"), F.regexp_replace(v, r"\+[^@]*@", "@"))


def profiles(rows: DataFrame) -> DataFrame:
    """One row an id of rows (id, email, first, last, phone), all of its spellings as sets.

    Columns: id, emails, phones, firsts, lasts (arrays, empty rather than null), full (first names with what short
    forms stand for), local (words of the e-mails' local parts)."""
    plain = rows.select(F.col("id").cast("string").alias("id"), plain_email(F.col("email")).alias("email"), plain_name(F.col("first")).alias("first"), plain_name(F.col("last")).alias("last"), phone_digits(F.col("phone")).alias("phone"))
    sets = [F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("email", "phone", "first", "last")]
    out = plain.where("id is not null").groupBy("id").agg(*sets)
    # One literal: a map of literals is a thousand expressions that every rule of the planner walks.
    short = F.from_json(F.lit(json.dumps(SHORT_FORMS)), "map<string,string>")
    full = F.array_distinct(F.flatten(F.transform("firsts", lambda x: F.concat(F.array(x), F.coalesce(F.split(F.try_element_at(short, x), " "), F.array().cast("array<string>"))))))
    words = F.flatten(F.transform("emails", lambda e: F.filter(F.split(F.regexp_extract(e, "^([^@]*)@", 1), "[^a-z]+"), lambda t: F.length(t) > 1)))
    lasts = F.array_distinct(F.flatten(F.transform("lasts", lambda x: F.concat(F.array(x), F.filter(F.split(x, "[ -]"), lambda t: F.length(t) > 2)))))
    return out.select("id", "emails", "phones", "firsts", lasts.alias("lasts"), full.alias("full"), F.array_distinct(words).alias("local"))


def near(x: Column, y: Column) -> Column:
    """Equal, or one slip apart: a letter missing, added, changed, or two neighbours swapped."""
    swapped = (F.levenshtein(x, y) == 2) & (F.length(x) == F.length(y)) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, "")))
    return (x == y) | ((F.least(F.length(x), F.length(y)) >= 3) & ((F.levenshtein(x, y) <= 1) | swapped))


def _some(a: Column, b: Column, test) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))


def _initial(x: Column, y: Column) -> Column:
    return ((F.length(x) == 1) | (F.length(y) == 1)) & (F.substring(x, 1, 1) == F.substring(y, 1, 1))


def name_columns() -> list[dict[str, Column]]:
    """What the names of two profiles (prefixes a_ and b_) say, in steps of which each reads the columns of those before:
    an expression that several columns need is in the plan once, for the planner goes over all of it again and again."""
    c = lambda s, n: F.col(f"{s}_{n}")
    exact = _some(c("a", "full"), c("b", "full"), near)
    lasts = _some(c("a", "lasts"), c("b", "lasts"), near)
    either = lambda x, y: near(x, y) | _initial(x, y)
    swapped = (_some(c("a", "full"), c("b", "lasts"), either) & _some(c("a", "lasts"), c("b", "full"), near)) | (
        _some(c("a", "lasts"), c("b", "full"), either) & _some(c("a", "full"), c("b", "lasts"), near)
    )

    def denied(s: str, o: str) -> Column:
        """Side s has an initial whose full name its e-mail tells, and it isn't a name of the other side."""
        told = lambda t: F.exists(c(s, "firsts"), lambda f: (F.length(f) == 1) & F.startswith(t, f)) & ~F.exists(F.concat(c("a", "lasts"), c("b", "lasts")), lambda n: F.endswith(t, n))
        return F.exists(c(s, "local"), lambda t: (F.length(t) > 2) & told(t) & ~F.exists(c(o, "full"), lambda y: near(t, y)))

    firsts = F.col("first_exact") | (_some(c("a", "full"), c("b", "full"), _initial) & ~denied("a", "b") & ~denied("b", "a"))

    def by_mail(s: str, o: str) -> Column:
        """No first name on side s: its e-mail has the other's first name, or the other's initial and last name."""
        named = _some(c(s, "local"), c(o, "full"), lambda t, f: near(t, f))
        short = F.exists(c(s, "local"), lambda t: F.exists(c(o, "lasts"), lambda n: F.exists(c(o, "firsts"), lambda f: t == F.concat(F.substring(f, 1, 1), n))))
        return named | short

    empty = lambda s, n: F.size(c(s, n)) == 0
    def other_in_mail(s: str, o: str) -> Column:
        """The e-mail of side s, whose first name is unknown, tells a name that is none of either side's."""
        lasts_of_both = F.concat(c("a", "lasts"), c("b", "lasts"))
        mine = lambda t: F.exists(lasts_of_both, lambda n: near(t, n) | F.endswith(t, n) | F.startswith(t, n) | (F.levenshtein(F.substring(t, 2, 99), n) <= 2)) | F.exists(c(o, "full"), lambda y: near(t, y) | _initial(t, y))
        return F.exists(c(s, "local"), lambda t: (F.length(t) > 2) & ~mine(t))

    # A last name in the place of the first, and nothing in its own: the first name is not known.
    half = (empty("a", "lasts") & _some(c("a", "full"), c("b", "lasts"), near)) | (empty("b", "lasts") & _some(c("b", "full"), c("a", "lasts"), near))
    unknown = empty("a", "firsts") | empty("b", "firsts")
    mail = F.when(empty("a", "firsts"), by_mail("a", "b")).when(empty("b", "firsts"), by_mail("b", "a"))
    whole = {
        "first_agrees": F.col("firsts_agree") | F.col("names_swapped"),
        "first_unknown": unknown | half,
        "mail_names": F.coalesce(mail, F.lit(False)),
        "mail_denies": (empty("a", "firsts") & ~empty("b", "firsts") & other_in_mail("a", "b")) | (empty("b", "firsts") & ~empty("a", "firsts") & other_in_mail("b", "a")),
        "last_agrees": F.col("lasts_agree") | F.col("names_swapped"),
        "last_unknown": empty("a", "lasts") | empty("b", "lasts"),
    }
    in_place = F.col("firsts_agree") & F.col("lasts_agree")
    return [{"first_exact": exact, "lasts_agree": lasts}, {"firsts_agree": firsts}, {"names_swapped": ~in_place & swapped}, whole]


@lru_cache(maxsize=1)
def _names_of(application: str) -> list[dict[str, Column]]:
    """name_columns(), built once an application: that takes longer than a small pass runs."""
    return name_columns()


#: SQL of the numbers in the local parts of a profile's e-mails.
NUMBERS = r"filter(transform(emails, e -> regexp_extract(e, r'^[^@]*?(\d{3,})[^@]*@', 1)), n -> n <> '')"
_LAST = "(last_agrees or last_unknown)"
SLIP = "exists(a_emails, x -> exists(b_emails, y -> levenshtein(x, y) <= 2 or substring_index(x, '@', 1) = substring_index(y, '@', 1)))"
#: The cascade: SQL giving the join keys of a profile, and the rules of that pass (name, condition on the pair), the
#: strongest first. A pair gets the first rule that holds.
PASSES: list[tuple[str, list[tuple[str, str]]]] = [
    ("emails", [("email+first+last", "first_agrees and last_agrees"), ("email+first", "first_agrees"), ("email", "first_unknown and not mail_denies")]),
    ("phones", [("phone+first+last", "first_agrees and last_agrees"), ("phone+first", "first_agrees and last_unknown"), ("phone+mail name", f"first_unknown and mail_names and {_LAST}")]),
    (NUMBERS, [("number+names", f"first_agrees and {_LAST} and {SLIP}"), ("number", f"first_unknown and not mail_denies and {_LAST} and {SLIP}")]),
]
#: The same for addresses without a number: a local part, or one less a letter, and a last name.
SLIPPED = (
    "flatten(transform(filter(emails, e -> not rlike(e, r'^[^@]*\\d{3}') and locate('@', e) between 4 and 65), e -> flatten(transform(lasts, n -> "
    "transform(sequence(0, locate('@', e) - 1), i -> concat(if(i = 0, substring_index(e, '@', 1), overlay(substring_index(e, '@', 1) placing '' from i for 1)), '|', n))))))"
)
PASSES.append((SLIPPED, [("slip+names", "first_exact and last_agrees and exists(a_emails, x -> exists(b_emails, y -> levenshtein(x, y) <= 1))")]))
#: The pass by which two ids of one source are the same person; its key is the contact.
WITHIN = [("array(key)", [("contact+first+last", "first_exact and last_agrees")])]
#: A contact that would form more pairs than this is split by names, or by spellings of the e-mail.
HOT_PAIRS = 625
#: Longer local parts meet each other without forms of their own.
LONG_LOCAL = 64

Forms = list[Column]


def _form(tag: str, text: Column, spelt: Column | None = None) -> Column:
    return F.struct(F.concat(F.lit(tag), text).alias("form"), (F.lit(None).cast("string") if spelt is None else spelt).alias("spelt"))


def _plain(tag: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: _form(tag, x))


def _without(x: Column) -> Column:
    """x with one letter left out, for each of its letters."""
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def _near(tag: str, names: Column) -> Column:
    """Forms of which two names have one in common if they are near(): the name, the name less a letter (any one slip
    but a swap of letters apart), and its letters in order (any swap)."""
    long = F.filter(names, lambda x: F.length(x) >= 3)
    less = F.flatten(F.transform(long, lambda x: F.transform(F.array_distinct(_without(x)), lambda y: _form(tag, y, x))))
    mixed = F.transform(long, lambda x: _form(tag, F.concat(F.lit("~"), F.array_join(F.sort_array(F.split(x, "")), "")), x))
    # Forms of one spelling don't meet: equal names have met by the name itself.
    return F.concat(_plain(tag, names), less, mixed)


def _if(condition: Column, forms: Column) -> Column:
    return F.when(condition, forms).otherwise(F.filter(forms, lambda _: F.lit(False)))


def _initials(tag: str, side: str, only: Column | None = None, other: Column | None = None) -> Forms:
    """An initial meets all names that begin with it. only: rows of side a, other: rows of side b that take part."""
    all_ = F.transform("full", lambda x: F.substring(x, 1, 1))
    single = F.filter("full", lambda x: F.length(x) == 1)
    pair = {"a": (all_, single), "b": (single, all_)}[side]
    takes = only if side == "a" else other
    return [_plain(f"{tag}{i}", x) if takes is None else _if(takes, _plain(f"{tag}{i}", x)) for i, x in enumerate(pair)]


def _swapped(side: str) -> Forms:
    x, y = ("lasts", "full") if side == "a" else ("full", "lasts")
    return [_near("x", F.col(x)), _near("y", F.col(y))]


def _email_forms(side: str) -> Forms:
    """For rules that ask for agreeing first names or for an unknown one that the e-mail doesn't deny."""
    nameless = F.size("firsts") == 0
    words = F.filter(F.split(F.regexp_extract("key", "^([^@]*)@", 1), "[^a-z]+"), lambda t: F.length(t) > 2)
    by_last = lambda t: F.exists("lasts", lambda n: near(t, n) | F.endswith(t, n) | F.startswith(t, n) | (F.levenshtein(F.substring(t, 2, 99), n) <= 2))
    by_first = lambda t: F.exists("full", lambda y: near(t, y) | _initial(t, y))
    # One word of the address that is not in the nameless one's own last names must be in the other's names.
    asked = F.coalesce(F.get(F.filter(words, lambda t: ~by_last(t)), F.lit(0)), F.lit(""))
    told = F.concat(F.array(F.lit("")), F.filter(words, lambda t: nameless | by_last(t) | by_first(t)))
    u, v = ("u", "v") if side == "a" else ("v", "u")
    unknown = [_if(nameless, _plain(u, F.array(asked))), _plain(v, told)]
    return [_near("f", F.col("full")), *_initials("i", side), *_swapped(side), *unknown]


def _last_forms(side: str) -> Forms:
    return [_near("l", F.col("lasts")), *_swapped(side)]


def _phone_forms(side: str) -> Forms:
    """For rules that ask for agreeing last names, for agreeing first names where a last name is unknown, or for an
    e-mail that tells the other's name."""
    nameless, no_last = F.size("firsts") == 0, F.size("lasts") == 0
    always = F.lit(True)
    c, d = ("c", "d") if side == "a" else ("d", "c")
    first = [_if(no_last, _near(c, F.col("full"))), _near(d, F.col("full")), *_initials("i", side, no_last, always), *_initials("j", side, always, no_last)]
    short = F.flatten(F.transform("firsts", lambda f: F.transform("lasts", lambda n: F.concat(F.substring(f, 1, 1), n))))
    m, n = ("m", "n") if side == "a" else ("n", "m")
    mail = [_if(nameless, _near(m, F.col("local"))), _near(n, F.col("full")), _plain(n, short)]
    return [*_last_forms(side), *first, *mail]


def _slip_forms(side: str) -> Forms:
    """For rules that ask for SLIP: of two e-mails at most two slips apart either the local parts are equal, or each
    part has one slip, or the domains are equal, or only the place of the @ differs."""
    local = lambda e: F.substring_index(e, "@", 1)
    ordinary = F.filter("emails", lambda e: F.length(local(e)) <= LONG_LOCAL)
    one = F.flatten(F.transform(ordinary, lambda e: F.concat(F.array(local(e)), _without(local(e)))))
    two = F.flatten(F.transform(ordinary, lambda e: F.flatten(F.transform(F.concat(F.array(local(e)), _without(local(e))), lambda x: F.transform(F.concat(F.array(x), F.when(F.length(x) > 0, _without(x)).otherwise(F.array(x))), lambda y: F.concat(y, F.lit("@"), F.substring_index(e, "@", -1)))))))
    long = F.transform(F.filter("emails", lambda e: F.length(local(e)) >= LONG_LOCAL - 1), lambda e: F.lit(""))
    joined = F.transform("emails", lambda e: F.replace(e, F.lit("@"), F.lit("")))
    return [_plain(t, F.array_distinct(x)) for t, x in (("s", F.transform("emails", local)), ("1", one), ("2", two), ("3", long), ("4", joined))]


#: The forms by which hot keys are split, so chosen that any pair one of the rules holds for has one in common.
FORMS = {"emails": _email_forms, "phones": _phone_forms, NUMBERS: _slip_forms, SLIPPED: lambda side: [_near("f", F.col("full"))]}
WITHIN_FORMS = {"array(key)": _last_forms}

#: What the rules read of a profile.
PARTS = ("emails", "firsts", "lasts", "full", "local")


def _keys(p: DataFrame, keys: str, *columns: str) -> DataFrame:
    return p.select(*columns, F.explode(F.array_distinct(F.expr(keys))).alias("key"))


def _hot(a: DataFrame, b: DataFrame, passes: list, hot_pairs: int) -> tuple[DataFrame, int]:
    """(pass, key) of keys that form more pairs than hot_pairs, and their number; counts are combined before the shuffle."""
    sides = []
    for p, n, m in ((a, 1, 0), (b, 0, 1)):
        tagged = ", ".join(f"transform(array_distinct({keys}), k -> struct({i} as pass, k as key))" for i, (keys, _) in enumerate(passes))
        sides.append(p.select(F.inline(F.expr(f"concat({tagged})"))).withColumns({"n": F.lit(n), "m": F.lit(m)}))
    counts = sides[0].unionByName(sides[1]).groupBy("pass", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return saved_rows(counts.where(F.col("n") * F.col("m") > hot_pairs).select("pass", "key"), "match-hot")


def _side(p: DataFrame, side: str) -> DataFrame:
    return p.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "done", *PARTS)])


def _split(p: DataFrame, forms: Forms, side: str) -> DataFrame:
    """(key, form, <side>_id, <side>_done, <side>_spelt): a row a form of rows with hot keys."""
    rows = p.select("key", "id", "done", F.explode(F.array_distinct(F.concat(*forms))).alias("x"))
    return rows.select("key", "x.form", F.col("id").alias(f"{side}_id"), F.col("done").alias(f"{side}_done"), F.col("x.spelt").alias(f"{side}_spelt"))


def _resolved(pairs: DataFrame, rules: list[tuple[str, str]], names: list[dict[str, Column]]) -> DataFrame:
    """(a_id, b_id, rule) of pairs with both sides' PARTS for which a rule holds. names: name_columns()."""
    rule = F.coalesce(*[F.when(F.expr(condition), F.lit(name)) for name, condition in rules])
    asked = set(re.findall(r"\w+", " ".join(condition for _, condition in rules)))
    said = pairs
    for step in names[:-1]:
        said = said.withColumns(step)
    said = said.withColumns({n: e for n, e in names[-1].items() if n in asked})
    return said.select("a_id", "b_id", F.explode(F.filter(F.array(rule), lambda r: r.isNotNull())).alias("rule"))


def cascade(a: DataFrame, b: DataFrame, passes=PASSES, forms=FORMS, hot_pairs: int = HOT_PAIRS, one_source: bool = False) -> DataFrame:
    """(a_id, b_id, rule): the pairs of two profiles() tables that some rule resolves, with the first that does.

    Each pass: exact join on the pass's key of what is unresolved on at least one side, and check of the names. No
    key is left out however many rows have it: one that forms more than hot_pairs pairs is joined on forms too.
    one_source: both tables are one, and only pairs with a_id < b_id are asked for. Ids without any attribute match
    nothing; empty tables give an empty result."""
    hot, n_hot = _hot(a, b, passes, hot_pairs)
    met_anew = (F.col("a_id") < F.col("b_id")) if one_source else ~(F.col("a_done") & F.col("b_done"))
    names = _names_of(a.sparkSession.sparkContext.applicationId)
    found: list[DataFrame] = []
    done: dict[str, DataFrame | None] = {"a": None, "b": None}
    for i, (keys, rules) in enumerate(passes):
        rows = {}
        for s, p in (("a", a), ("b", b)):
            p = p.withColumn("done", F.lit(False)) if done[s] is None else p.join(done[s], "id", "left").fillna(False, ["done"])
            rows[s] = p.select("id", "done", *PARTS, F.explode(F.array_distinct(F.expr(keys))).alias("key"))
        cold, of_pass = rows, hot.where(F.col("pass") == i).select("key")
        if n_hot:
            cold = {s: r.join(of_pass, "key", "left_anti") for s, r in rows.items()}
        new = _resolved(_side(cold["a"], "a").join(_side(cold["b"], "b"), "key").where(met_anew), rules, names)
        if n_hot:
            warm = {s: _split(r.join(of_pass, "key", "left_semi"), forms[keys](s), s) for s, r in rows.items()}
            met = warm["a"].join(warm["b"], ["key", "form"]).where(met_anew & F.expr("a_spelt is null or b_spelt is null or a_spelt <> b_spelt"))
            pairs = met.select("a_id", "b_id").distinct()
            for s, p in (("a", a), ("b", b)):
                pairs = pairs.join(p.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", *PARTS)]), f"{s}_id")
            new = new.unionByName(_resolved(pairs, rules, names))
        new = saved(new.distinct(), "match-pass")
        found.append(new)
        if len(found) < len(passes):
            for s in "ab":
                ids = new.select(F.col(f"{s}_id").alias("id"), F.lit(True).alias("done"))
                done[s] = (ids if done[s] is None else ids.unionByName(done[s])).distinct()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("a_id", "b_id").agg(F.min_by("rule", F.array_position(F.array(*[F.lit(n) for _, rules in passes for n, _ in rules]), F.col("rule"))).alias("rule")) if len(found) > 1 else out


def persons(profiles: DataFrame, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(person, id) for every id of a table of profiles() whose ids begin with their source's letter, and the profiles
    of the persons (id being the person).

    Ids of one source are one person if they share a contact and their names agree, over any chain of such ties. Equal
    names at one contact are a class that takes part once, so copies of a person form no pairs among themselves."""
    contacts = "concat(transform(emails, e -> concat(left(id, 1), 'e', e)), transform(phones, e -> concat(left(id, 1), 'p', e)))"
    named = profiles.where((F.size("full") > 0) & (F.size("lasts") > 0))
    keyed = _keys(named, contacts, "id", "firsts", "full", "lasts").withColumn("class", F.md5(F.to_json(F.struct("key", "full", "lasts"))))
    keyed, n_keyed = saved_rows(keyed, "match-contacts")
    classes = keyed.groupBy("class", "key", "firsts", "full", "lasts").agg(F.count(F.lit(1)).alias("n"))
    classes = saved(classes, "match-classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    none = F.array().cast("array<string>")
    meeting = classes.join(several, "key", "left_semi").select(F.col("class").alias("id"), "key", none.alias("emails"), "firsts", "lasts", "full", none.alias("local"))
    ties = cascade(*[saved(meeting, "match-meeting")] * 2, WITHIN, WITHIN_FORMS, hot_pairs, one_source=True)
    tied = ties.select(F.explode(F.array("a_id", "b_id")).alias("class"))
    live = classes.where("n > 1").select("class").unionByName(tied).distinct()
    stars = keyed.select("class", "id")
    stars = lookup_join(stars, live, "class", "inner", least=HOT_LEAST) if n_keyed >= HOT_LEAST else stars.join(live, "class")
    links = stars.select(F.col("class").alias("a"), F.concat(F.lit("#"), "id").alias("b")).unionByName(ties.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    groups = components(links).where("v like '#%'").select(F.expr("substring(v, 2)").alias("id"), F.concat(F.substring("v", 2, 1), F.lit("*"), F.col("root").cast("string")).alias("person"))
    members = saved(profiles.join(groups, "id", "left"), "match-members")
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    grouped = members.where("person is not null").groupBy(F.col("person").alias("id")).agg(*[union(c) for c in ("emails", "phones", "firsts", "lasts", "full", "local")])
    whole = members.where("person is null").select(*grouped.columns).unionByName(grouped)
    return members.select(F.coalesce("person", "id").alias("person"), "id"), saved(whole, "match-persons")


def match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, rule) of the same people in two tables of profiles(), each pair with its persons' rule."""
    tagged = [p.withColumn("id", F.concat(F.lit(s), "id")) for s, p in (("a", a), ("b", b))]
    members, whole = persons(saved(tagged[0].unionByName(tagged[1]), "profiles"))
    pairs = cascade(*[whole.where(F.startswith("id", F.lit(s))) for s in "ab"])
    for s in "ab":
        own = members.where(F.startswith("id", F.lit(s))).select(F.col("person").alias(f"{s}_id"), F.expr("substring(id, 2)").alias(f"_{s}"))
        pairs = pairs.join(own, f"{s}_id")
    return pairs.select(F.col("_a").alias("a_id"), F.col("_b").alias("b_id"), "rule")


def with_confidence(pairs: DataFrame, labels: DataFrame, prior: float = 0.9, weight: float = 4.0) -> DataFrame:
    """pairs with `confidence`, their rule's precision on labelled pairs: (right + prior * weight) / (labelled + weight).

    labels: (side, id, entity) rows, side being a or b. A pair is labelled if both of its records are, and right if
    they share an entity. Without labels every rule has the prior."""
    known = labels.where("entity is not null").distinct()
    on = lambda s: known.where(F.col("side") == s).select(F.col("id").alias(f"{s}_id"), "entity")
    has = lambda s: on(s).select(f"{s}_id").distinct()
    right = pairs.select("a_id", "b_id").join(on("a"), "a_id").join(on("b"), ["b_id", "entity"]).select("a_id", "b_id").distinct().withColumn("right", F.lit(1))
    labelled = pairs.join(has("a"), "a_id", "left_semi").join(has("b"), "b_id", "left_semi").join(right, ["a_id", "b_id"], "left")
    precision = labelled.groupBy("rule").agg(((F.sum(F.coalesce("right", F.lit(0))) + prior * weight) / (F.count(F.lit(1)) + weight)).alias("confidence"))
    return pairs.join(F.broadcast(precision), "rule", "left").withColumn("confidence", F.coalesce("confidence", F.lit(prior)))
