"""Problem 2: variant spellings of persons' and organisations' names, by noisy-channel attribution.

Each spelling is read once: titles, legal forms and order are resolved, and a name of the family
(surname, or an organisation's own name) is found. A rare family name is attached to the frequent
one that explains it best; within a family, spellings that stand alone are candidates for the
canonical form, and every other goes to the candidate of the greatest posterior: the logarithm of
the candidate's frequency plus that of the likelihood of its typos, abbreviations and nicknames.
Only different spellings with their counts are moved, so a name typed a million times is one row.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut

# Given names with their usual short and pet forms, in the order of the alphabet.
NICKNAMES = {
    "aaron": "ron ronnie", "abigail": "abby abbie gail", "abraham": "abe bram", "adelaide": "addie heidi", "albert": "al bert bertie", "alejandro": "alex jandro", "alexander": "alex al sandy sasha xander lex alec", "alexandra": "alex sandra sasha lexi",
    "alfred": "alf alfie fred", "alice": "ali allie", "amanda": "mandy", "anastasia": "nastya stacy", "andreas": "andi andy", "andrew": "andy drew", "angela": "angie", "anne": "annie nan nancy", "anthony": "tony ant", "antonio": "toni tonio", "arthur": "art artie",
    "augustine": "gus augie", "barbara": "babs barb barbie", "bartholomew": "bart barry", "beatrice": "bea trixie", "benjamin": "ben benny benji benjy", "bernard": "bernie", "caroline": "carrie caro", "catherine": "cathy kate cat kitty", "cecilia": "cissy celia",
    "charles": "charlie chuck chaz", "charlotte": "lottie charlie lotte charly", "christian": "chris", "christina": "chris chrissie tina", "christopher": "chris kit topher", "clarence": "clare", "constantin": "costa kostya costin stan", "cornelius": "neil corny", "cynthia": "cindy",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima mitya", "dolores": "lola", "dominic": "dom nick", "donald": "don donnie", "dorothea": "thea dora dot dottie", "dorothy": "dot dottie dolly", "edgar": "ed eddie", "edmund": "ned ed eddie ted",
    "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty lizzie eliza bess libby lisa", "emanuel": "manny", "emily": "em emmy millie", "ernest": "ernie", "eugene": "gene", "evelyn": "eve evie", "felicity": "fliss", "ferdinand": "ferdi nando",
    "florence": "flo florrie", "frances": "fran fanny", "francesca": "fran frankie cesca franny", "francis": "frank", "francisco": "paco pancho", "franz": "franzl", "frederick": "fred freddy freddie fritz", "friedrich": "fritz", "gabriel": "gabe", "gabriela": "gabi gaby", "genevieve": "gen viv",
    "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gert", "gilbert": "gil bert", "giovanni": "gianni nino", "giuseppe": "beppe pino", "gregory": "greg gregor", "guadalupe": "lupe", "harold": "harry hal", "heinrich": "heinz heini", "helen": "nell",
    "henrietta": "hetty etta", "henry": "hank harry hal", "hildegard": "hilda hilde hildy", "howard": "howie", "hubert": "bert hugh", "ignacio": "nacho iggy", "isabella": "izzy bella isa belle", "isabelle": "izzy belle isa", "ivan": "vanya", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie",
    "janet": "jan", "jennifer": "jen jenny", "jessica": "jess jessie", "joanna": "jo", "johannes": "hannes hans johann jan", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe joey", "josephine": "jo josie fifi joey", "joshua": "josh", "judith": "judy", "julia": "jules",
    "karl": "kalle", "katarzyna": "kasia kate katya", "katherine": "kathy kate katie kit kitty kath", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry laurie", "leonard": "len lenny leo", "leonardo": "leo leon lenny nardo", "leopold": "leo poldi", "lorenzo": "enzo renzo", "louis": "lou louie", "ludwig": "lutz",
    "magdalena": "lena magda", "manuel": "manolo", "margaret": "maggie meg peggy marge greta margie", "maria": "mia mimi", "martha": "marty", "martin": "marty", "matthew": "matt matty", "maurice": "mo", "maximilian": "max", "michael": "mike mick micky", "mikhail": "misha", "nancy": "nan", "natalia": "natasha tasha talia", "nathaniel": "nat nate",
    "nicholas": "nick nicky nico klaus claus", "nikolai": "kolya", "oliver": "ollie oli olli olly", "olivia": "liv livvy", "olivier": "ollie oli olli olly", "oscar": "ozzie", "pamela": "pam", "patricia": "trish pat patty tricia patsy", "patrick": "pat paddy", "penelope": "penny nell poppy", "peter": "pete", "philip": "phil pip",
    "quentin": "quin quinn quint", "rachel": "rae", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "rosalind": "roz rosa lindy ros", "rosemary": "rose rosie", "rudolf": "rudi", "samantha": "sam", "samuel": "sam sammy", "sebastian": "seb bastian",
    "sergei": "seryozha", "simon": "si", "sophia": "sophie", "stanley": "stan", "stefan": "steff", "stephanie": "steph", "stephen": "steve stevie", "steven": "steve stevie", "susan": "sue susie suzy", "sylvester": "sly", "tatiana": "tanya", "teresa": "terry tess", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "ulrich": "uli", "ulrike": "uli rike ulli", "ursula": "ulla uschi", "valentina": "val tina valya", "veronica": "ronnie vera", "victor": "vic", "victoria": "vicky tori", "vincent": "vince vin vinny vinnie", "virginia": "ginny", "vladimir": "vova volodya", "walter": "walt wally", "wilhelm": "willi", "wilhelmina": "mina willa minnie billie",
    "william": "bill will billy liam willy", "winifred": "winnie freda", "xavier": "javi", "yevgenia": "zhenya genia", "zachary": "zach zack zac zak",
}
PET_NAMES: dict[str, frozenset[str]] = {}
for _full, _pets in NICKNAMES.items():
    for _pet in _pets.split():
        PET_NAMES[_pet] = PET_NAMES.get(_pet, frozenset()) | {_full}
# Titles and degrees, legal forms, and words for kinds of organisations.
TITLES = set("dr prof professor mr mrs ms miss sir madam phd md msc bsc ma esq jr sr ing dipl herr frau mme mlle sra".split())
LEGAL = set("inc incorporated ltd limited llc llp plc gmbh ag kg sa sas sarl spa corp corporation co company bv nv oy ab srl pty international intl group holding holdings gesellschaft mbh".split())
KINDS_OF_ORG = {"university": "university", "univ": "university", "universitat": "university", "universite": "university", "uni": "university", "institute": "institute", "inst": "institute", "institut": "institute"}
SMALL_WORDS = set("the of for and".split())
PERSON_TYPES, ORG_TYPES = ("person", "people", "persons", "human", "per"), ("org", "orgs", "organization", "organisation", "organizations", "organisations", "company", "companies")
PLACEHOLDERS = set("- -- n/a na none null nil unknown default test tbd ? ?? . x xxx anonymous nobody name".split())

#: Log likelihoods of the channel: of one edit, a pet name, an initial, a clipped form, a left-out or added middle name.
EDIT, PET, INITIAL, CLIPPED, MIDDLE = -3.0, -1.0, -1.5, -1.2, -0.5
#: And of an edit in a family name.
FAMILY_EDIT = -1.4
NEVER = -math.inf


def plain(text: str) -> str:
    """Lower case without accents; ø and the like become their base letters."""
    text = text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("ß", "ss").replace("đ", "d").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _words(name: str) -> list[str]:
    """Words with their case and full stops; words typed together are parted, a hyphen inside a word goes."""
    name = re.sub(r"\(.*?\)", " ", name)
    name = re.sub(r"(?<=\w)-(?=[a-zà-ÿ])", "", name)
    name = re.sub(r"(?<=[a-zà-ÿ]{2})(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", name)
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?|&|\+", name)


def read_person(name: str) -> tuple[str, str, str, bool] | None:
    """(first word or words before the family name, middle, family name, whether a comma fixed the order).

    An initial is one letter; a clipped given name keeps its full stop.
    """
    head, comma, tail = name.partition(",")
    if comma and all(plain(w).strip(".") in TITLES for w in _words(tail)):
        head, comma, tail = head, "", ""
    shouted = name == name.upper()

    def givens(words: list[str]) -> list[str]:
        out: list[str] = []
        for w in words:
            bare = w.rstrip(".")
            if plain(bare) in TITLES and not (len(bare) <= 2 and w == bare and not out and len(words) == 1):
                continue
            if len(bare) <= 2 and bare == bare.upper() and not (shouted and len(bare) == 2):
                out += [plain(c) for c in bare]
            else:
                out.append(plain(w) if w.endswith(".") and len(bare) > 1 else plain(bare))
        return out

    if comma:
        family, rest = givens(_words(head)), givens(_words(tail.replace(",", " ")))
        if not family or not rest:
            return None
        return rest[0], rest[1] if len(rest) > 1 else "", family[-1].strip("."), True
    words = givens(_words(head))
    if len(words) < 2:
        return None
    return words[0], words[1] if len(words) > 2 else "", words[-1].strip("."), False


def read_org(name: str) -> tuple[str, str, str] | None:
    """(own name, kind, the other words in order): the parts that tell organisations apart."""
    name = re.sub(r"\b((?:[A-Za-z]\. ?){2,}(?:[A-Za-z]\b)?)", lambda m: re.sub(r"[. ]", "", m[0]) + " ", name)
    head, comma, tail = name.partition(",")
    words = [*_words(tail), *_words(head)] if comma and [w for w in _words(tail) if plain(w).strip(".") not in LEGAL] else _words(name.replace(",", " "))
    kind, rest = "", []
    for w in words:
        p = plain(w)
        bare = p.strip(".")
        near = next((k for k in ("university", "institute") if len(bare) > 6 and edits(bare, k) <= 2), "")
        if bare in KINDS_OF_ORG or near:
            kind = KINDS_OF_ORG.get(bare, near)
        elif bare and bare not in LEGAL and bare not in SMALL_WORDS and p not in "&+" and not any(len(bare) > 6 and edits(bare, x, 1) <= 1 for x in ("corporation", "incorporated", "limited", "company", "international")):
            rest.append(p if p.endswith(".") and len(bare) > 1 else bare)
    if not rest or len(rest[0].strip(".")) < 2:
        return None
    if len(rest) > 1 and re.search(r"\S\s*(?:&|\+|\band\b)\s*\S", plain(name)) and len(rest[1]) > len(rest[0]):
        rest[:2] = rest[1::-1]  # partners may be named in either order
    return rest[0].strip("."), kind, " ".join(rest[1:])


def word_likelihood(seen: str, meant: str) -> float:
    """log P(a word was typed as seen | it is meant): typos, clipping, initials."""
    if seen == meant:
        return 0.0
    bare = seen.rstrip(".")
    if len(bare) == 1 or len(meant.rstrip(".")) == 1:
        return INITIAL if bare[:1] == meant[:1] and len(bare) == 1 else NEVER
    if seen.endswith("."):
        return CLIPPED if meant.startswith(bare) else NEVER
    if meant in PET_NAMES.get(seen, ()):
        return PET
    d = edits(seen, meant, 2 if min(len(seen), len(meant)) > 6 else 1)
    return EDIT * d if d <= (2 if min(len(seen), len(meant)) > 6 else 1) and min(len(seen), len(meant)) > 3 else NEVER


def person_likelihood(seen: tuple[str, str], meant: tuple[str, str]) -> float:
    first = word_likelihood(seen[0], meant[0])
    if first == NEVER and any(edits(seen[0], full, 1) <= 1 for full in PET_NAMES.get(meant[0], ())):
        first = PET  # the pet name is the frequent form of a name typed in full
    if first == NEVER:
        return NEVER
    if not seen[1] or not meant[1]:
        return first + (MIDDLE if seen[1] != meant[1] else 0.0)
    a, b = seen[1].rstrip("."), meant[1].rstrip(".")
    if a == b:
        return first
    if len(a) == 1 or len(b) == 1:
        return first + (INITIAL if a[0] == b[0] else NEVER)
    return first + word_likelihood(a, b)


def org_likelihood(seen: tuple[str, str], meant: tuple[str, str]) -> float:
    """Kind and other words must agree: organisations of one name in other fields are different."""
    if seen[0] != meant[0]:
        return NEVER
    a, b = seen[1].split(), meant[1].split()
    if len(a) != len(b):
        return NEVER
    return sum(word_likelihood(x, y) for x, y in zip(a, b))


def shortened(word: str) -> set[str]:
    """The word and every word with one letter less, of long ones with two: words within as many edits share one."""
    if len(word) < 4:
        return {word}
    once = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | once | ({w[:i] + w[i + 1 :] for w in once for i in range(len(w))} if len(word) > 6 else set())


class Heads:
    """Candidates for the canonical form, found by what their leading word could have been typed as.

    The leading word is a person's given name, or the first of an organisation's other words.
    """

    def __init__(self, kind: str) -> None:
        self.person = kind == "person"
        self.by: dict[tuple[str, ...], list[tuple[str, str]]] = {}

    def _lead(self, form: tuple[str, str]) -> tuple[str, tuple[str, ...]]:
        """The leading word, and what must agree exactly."""
        if self.person:
            return form[0], ()
        words = form[1].split()
        return words[0] if words else "", (form[0], str(len(words)))

    def add(self, head: tuple[str, str]) -> None:
        lead, same = self._lead(head)
        keys = {("word", lead), ("letter", lead[:1]), ("start", lead[:3])} | {("near", w) for w in shortened(lead)}
        if self.person:
            keys |= {("pet", w) for full in PET_NAMES.get(lead, ()) for w in shortened(full)}
        for key in keys:
            self.by.setdefault((*same, *key), []).append(head)

    def near(self, form: tuple[str, str]) -> list[tuple[str, str]]:
        """All candidates that could explain the form, and few others."""
        lead, same = self._lead(form)
        bare = lead.rstrip(".")
        if len(bare) == 1:
            keys = {("letter", bare)}
        elif lead.endswith("."):
            keys = {("word", lead), ("start", bare[:3]) if len(bare) > 2 else ("letter", bare[:1])}
        else:
            keys = {("near", w) for w in shortened(lead)} | {("word", full) for full in PET_NAMES.get(lead, ())}
            if self.person:
                keys |= {("pet", w) for w in shortened(lead)}
        return list(dict.fromkeys(h for key in sorted(keys) for h in self.by.get((*same, *key), ())))


def attribute(kind: str, forms: dict[tuple[str, str], int], known: dict[str, int]) -> dict[tuple[str, str], tuple[str, str]]:
    """The canonical form of every form of a family.

    forms: how many rows have each; known: how often each first word stands in the whole table. A
    form that could be several candidates by an initial or clipped name alone stays by itself.
    """
    score = person_likelihood if kind == "person" else org_likelihood

    def prior(form: tuple[str, str]) -> float:
        return math.log(1 + forms[form]) + (0.5 * math.log(1 + known.get(form[0], 0)) if kind == "person" else 0.0)

    def weak(form: tuple[str, str]) -> bool:
        return any(len(w.rstrip(".")) == 1 or w.endswith(".") for w in (form[0].split() if kind == "person" else form[1].split()))

    ranked = sorted(forms, key=lambda f: (weak(f), -prior(f), -len(f[1]), f))
    chosen: dict[tuple[str, str], tuple[str, str]] = {}
    heads = Heads(kind)
    middles: dict[tuple[str, str], str] = {}  # the middle name that the forms of a head agree on
    for form in ranked:
        found = []
        for head in heads.near(form):
            meant = (head[0], middles[head] if kind == "person" else head[1])
            if (s := score(form, meant)) > NEVER:
                found.append((s + prior(head), head))
        found.sort(key=lambda x: (-x[0], x[1]))
        if not found:
            heads.add(form)
            chosen[form], middles[form] = form, form[1]
            continue
        if weak(form) and len(found) > 1:
            exact = [x for x in found if kind == "person" and form[1] and middles[x[1]][:1] == form[1][:1]]
            if len(exact) != 1:
                chosen[form] = form
                continue
            found = exact
        head = found[0][1]
        chosen[form] = head
        if kind == "person" and len(form[1]) > len(middles[head]):
            middles[head] = form[1]
    return chosen


def _dropped(word: Column) -> Column:
    """Every word with one letter less."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _keys(word: Column) -> Column:
    """The word and every word with one letter less, of words of eight letters and more with two."""
    once = _dropped(word)
    twice = F.when(F.length(word) >= 8, F.flatten(F.transform(once, _dropped))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(word) < 3, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), once, twice)))


def family_heads(families: DataFrame) -> DataFrame:
    """(kind, family, head): the families that are attached to another, at the end of every chain.

    families has _kind, _family and _n, its rows. Candidates are the words within an edit or a swap of
    neighbours, two for rare names of eight letters or more. Of those frequent enough to outweigh the
    edits - four times as frequent, or the name has at most three rows; fifty times for names of three
    or four letters - the greatest posterior counts, log frequency plus log likelihood of the edits;
    ties go to the more frequent, then to the greater word. Words of one shortened form differ by its
    missing letters, so a key holds few of them however large the table is.
    """
    keyed = families.withColumn("_key", F.explode(_keys(F.col("_family"))))
    heads = keyed.select("_kind", "_key", F.col("_family").alias("_head"), F.col("_n").alias("_hn"))
    letters = lambda w: F.array_sort(F.split(w, ""))
    pairs = (
        keyed.join(heads, ["_kind", "_key"])
        .where(F.struct("_hn", "_head") > F.struct(F.col("_n").alias("_hn"), F.col("_family").alias("_head")))  # so no two are attached to each other
        .select("_kind", "_family", "_n", "_head", "_hn")
        .distinct()
        .withColumn("_d", F.levenshtein("_family", "_head"))
        .withColumn("_d", F.when((F.col("_d") == 2) & (letters(F.col("_family")) == letters(F.col("_head"))), 1).otherwise(F.col("_d")))
    )
    size, n, head = F.least(F.length("_family"), F.length("_head")), F.col("_n"), F.col("_hn")
    enough = F.when(size < 5, head >= 50 * n).when(F.col("_d") == 1, (head >= 4 * n) | (n <= 3)).otherwise((size >= 8) & (n <= 3) & (head >= 4 * n))
    posterior = F.log(F.col("_hn")) + FAMILY_EDIT * F.col("_d")
    better = pairs.where((F.col("_d") <= 2) & (size > 2) & enough).groupBy("_kind", "_family").agg(F.max(F.struct(posterior.alias("p"), F.col("_hn"), F.col("_head"))).alias("_top"))
    chain = cut(better.select("_kind", "_family", F.col("_top._head").alias("_head")))
    while True:  # each round doubles the steps followed, until all are at their end
        step = chain.select("_kind", F.col("_family").alias("_head"), F.col("_head").alias("_next"))
        longer = chain.join(step, ["_kind", "_head"], "left")
        if longer.where("_next is not null").isEmpty():
            return chain
        chain = cut(longer.select("_kind", "_family", F.coalesce("_next", "_head").alias("_head")))


def name_classes(entities: DataFrame, entity_id: str = "entity_id", name: str = "name", type_: str = "type") -> DataFrame:
    """(entity_id, kind, class_id): the class of each row that names a person or an organisation.

    Rows with a null id, name or type, blank and placeholder names, and other types have no row;
    copies count once. A name that can't be read as a given and a family name, or as an
    organisation's, is a class with the same text only. The result doesn't depend on input order.
    """
    known_type = F.lower(F.trim(F.col(type_)))
    kind = F.when(known_type.isin(*PERSON_TYPES), "person").when(known_type.isin(*ORG_TYPES), "org")
    slim = (
        entities.select(F.col(entity_id).alias("_id"), F.trim(F.regexp_replace(F.col(name), r"\s+", " ")).alias("_name"), kind.alias("_kind"))
        .where("_id is not null and _kind is not null and _name <> ''")
        .where(~F.lower("_name").isin(*PLACEHOLDERS))
        .distinct()
    )
    spelled = slim.groupBy("_kind", "_name").agg(F.count("*").alias("_rows"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text, rows in zip(frame["_kind"], frame["_name"], frame["_rows"]):
                if k == "person":
                    got = read_person(text)
                    a, b, family, fixed = got if got else ("", "", plain(text), True)
                else:
                    org = read_org(text)
                    family, a, b = org if org else (plain(text), "", "")
                    fixed = True
                out.append((k, text, rows, a, b, family, fixed))
            yield pd.DataFrame(out, columns=["_kind", "_name", "_rows", "_a", "_b", "_family", "_fixed"])

    parsed = spelled.mapInPandas(parse, "_kind string, _name string, _rows bigint, _a string, _b string, _family string, _fixed boolean")

    parsed = cut(parsed)  # read by each step below

    # Which words are given names: those that stand first more often than last.
    sides = parsed.where("_kind = 'person' and _a <> ''").select(F.explode(F.array(F.struct(F.col("_a").alias("w"), F.col("_rows").alias("g"), F.lit(0).cast("long").alias("s")), F.struct(F.col("_family").alias("w"), F.lit(0).cast("long").alias("g"), F.col("_rows").alias("s")))).alias("x"))
    use = sides.groupBy(F.col("x.w").alias("_w")).agg(F.sum("x.g").alias("_g"), F.sum("x.s").alias("_s"))
    first, last = use.select(F.col("_w").alias("_a"), F.col("_g").alias("_ag"), F.col("_s").alias("_as")), use.select(F.col("_w").alias("_family"), F.col("_g").alias("_fg"), F.col("_s").alias("_fs"))
    turned = parsed.join(first, "_a", "left").join(last, "_family", "left")
    swap = (~F.col("_fixed")) & (F.col("_kind") == "person") & (F.length("_a") > 2) & (F.col("_as") > F.col("_ag")) & (F.col("_fg") > F.col("_fs"))
    oriented = turned.select(
        "_kind", "_name", "_rows", F.when(swap, F.col("_family")).otherwise(F.col("_a")).alias("_a"), "_b", F.when(swap, F.col("_a")).otherwise(F.col("_family")).alias("_family"), F.when(swap, F.col("_fg")).otherwise(F.coalesce("_ag", F.lit(0))).alias("_known")
    )

    oriented = cut(oriented)
    chain = family_heads(oriented.groupBy("_kind", "_family").agg(F.sum("_rows").alias("_n")))
    grouped = oriented.join(chain, ["_kind", "_family"], "left").withColumn("_head", F.coalesce("_head", "_family"))

    def family(kind: str, head: str, rows: list[tuple[str, str, str, int, int]]) -> list[tuple[str, str, str]]:
        forms: dict[tuple[str, str], int] = {}
        known: dict[str, int] = {}
        for _, a, b, n, often in rows:
            forms[a, b] = forms.get((a, b), 0) + n
            known[a] = often
        got = attribute(kind, forms, known)
        return [(kind, name, f"{kind}:{head}:{' '.join(got[a, b])}") for name, a, b, _, _ in rows]

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows, family by family; a family may run on from frame to frame."""
        key, rows = None, []
        for frame in frames:
            out = []
            for kind, head, *row in frame.itertuples(index=False, name=None):
                if (kind, head) != key:
                    if key:
                        out += family(*key, rows)
                    key, rows = (kind, head), []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=["_kind", "_name", "_class"])
        if key:
            yield pd.DataFrame(family(*key, rows), columns=["_kind", "_name", "_class"])

    # Few bytes but much work: the number of partitions is the session's, not what their size would ask for.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = grouped.select("_kind", "_head", "_name", "_a", "_b", "_rows", F.coalesce("_known", F.lit(0)).cast("long").alias("_known")).repartition(parts, "_kind", "_head").sortWithinPartitions("_kind", "_head")
    classes = sorted_.mapInPandas(resolve, "_kind string, _name string, _class string")
    return slim.join(classes, ["_kind", "_name"]).select(F.col("_id").alias(entity_id), F.col("_kind").alias("kind"), F.col("_class").alias("class_id")).distinct()


def with_links(classes: DataFrame) -> DataFrame:
    """The classes with links: to how many other rows each row is linked."""
    return classes.join(classes.groupBy("class_id").agg((F.count("*") - 1).alias("links")), "class_id")


def linked_pairs(classes: DataFrame, entity_id: str = "entity_id") -> DataFrame:
    """(entity_a, entity_b), entity_a < entity_b: the pairs that share a class."""
    a = classes.select("class_id", F.col(entity_id).alias("entity_a"))
    b = classes.select("class_id", F.col(entity_id).alias("entity_b"))
    return a.join(b, "class_id").where("entity_a < entity_b").select("entity_a", "entity_b").distinct()
