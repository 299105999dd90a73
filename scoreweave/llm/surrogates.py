"""Personal data replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.storage import bounded
from scoreweave.llm.words import pieces
from scoreweave.session import cut_lineage

#: Stands in where the caller gives no key. Whoever has the key can tell which surrogate is whose.
DEMO_KEY = b"scoreweave-demo"
#: Rounds of choosing anew for entities whose surrogate is taken.
ROUNDS = 30

# Titles by gender, and syllables of names by script and gender.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Prof": "n"}
STARTS = {"latin": "ba be da de fa ga ha ja ka la le li ma me mi na ne ra re ri sa se ta te va vi".split(), "cyrillic": "ба ва га да за ка ла ма на па ра са та ви ли ми ни ри".split(), "greek": "βα γα δα ζα θα κα λα μα να πα ρα σα τα φι λι μι".split()}
GIVEN_ENDS = {("latin", "m"): "ron las ton vin mer rik".split(), ("latin", "f"): "na la ria sa nia ta".split(), ("latin", "n"): "ren lin kim ris".split(), ("cyrillic", "m"): "мир слав дан рий".split(), ("cyrillic", "f"): "на ра ля ния".split(), ("cyrillic", "n"): "ша ня".split(), ("greek", "m"): "νος ρης κος".split(), ("greek", "f"): "να ρα νη".split(), ("greek", "n"): "λι ρι".split()}
FAMILY_ENDS = {("latin", "m"): "son man berg ley ford well".split(), ("cyrillic", "m"): "ов ин ский".split(), ("cyrillic", "f"): "ова ина ская".split(), ("greek", "m"): "δης ου κης".split()}

TITLES |= {t.upper(): g for t, g in TITLES.items()}
#: Country codes of telephone numbers; all others have three digits.
COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3}")

_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:-[^\W\d_a-z][^\W\d_]+)?"
_HEX = r"[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: In order of precedence; each kind is one named group.
ENTITIES = re.compile(
    r"(?P<email>[\w.%+-]*[\w%+-]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])*\.[A-Za-z]{2,})"
    r"|(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[ \t]*[:=][ \t]*[\"'])(?P<secret>[^\"'\s]{6,})(?=[\"'])"
    r"|(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[ \t]*[:=][ \t]*)(?P<bare>(?=[^\s\"',;]*[0-9])(?=[^\s\"',;]*[A-Za-z])[^\s\"',;<>]{6,})"
    r"|\b(?P<access>AKIA[0-9A-Z]{16})\b"
    rf"|(?<![\w:.])(?P<ip6>(?:{_HEX}:){{7}}{_HEX}|(?=[\w:]*[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])"
    r"|\b(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"
    rf"|(?<![\w.])(?<!ersion )(?<!ersion: )(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?!\.?[0-9])"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![\w.-])(?:1(?:[ .-]|(?=\()))?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    r"|(?<![\w.-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![\w-]))"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w.])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"
    rf"|\b(?P<title>(?:{_TITLE})\b\.?(?:[ ](?:{_TITLE})\b\.?)*)[ ](?P<name>{_NAME}(?:[ ]{_NAME})?)"
)
#: What any entity needs; most texts have none of it and skip the search.
WORD = re.compile(rf"(?<!\w)(?:{_NAME}|(?:a|an|the|ein|eine|einen|der|die|das|un|une|le|la|el|una)(?= ))(?!\w)")
TRIGGER = re.compile(rf"[0-9@]|[\"']|\bAKIA|\b(?:{_TITLE})\b")
STACK = re.compile(_TITLE)
#: Groups that name the same kind of entity as another.
KINDS = {"bare": "secret", "access": "secret", "ip6": "ip"}
#: A name after one of these is a word: "a Brown bear".
ARTICLES = {"a", "an", "the", "ein", "eine", "einen", "der", "die", "das", "un", "une", "le", "la", "el", "una"}


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canonical: str
    text: str

    def entities(self) -> list[tuple[str, str]]:
        """What has a surrogate of its own: of a name, the given and the family name, and of an address its host."""
        if self.kind == "email":
            return [("host", self.canonical.rpartition("@")[2]), ("email", self.canonical)]
        if self.kind != "name":
            return [(self.kind, self.canonical)]
        gender, script, said = self.canonical.split(":", 2)
        *given, family = said.split(" ")
        return [("given", f"{gender}:{script}:{g}") for g in given] + [("name", f"{_family_gender(gender, script, family)}:{script}:{family}")]


def _script(text: str) -> str:
    return next((s for s, lo, hi in (("cyrillic", "\u0400", "\u04ff"), ("greek", "\u0370", "\u03ff")) if any(lo <= c <= hi for c in text)), "latin")


def _family_gender(gender: str, script: str, family: str) -> str:
    """Only Cyrillic family names show a gender; after a title of none it is read off the ending."""
    if script != "cyrillic":
        return "m"
    return gender if gender != "n" else "f" if family.endswith(("а", "я")) else "m"


def _name(gender: str, said: str) -> str:
    """The canonical form of a name: case folded, with the title's gender where the form shows one."""
    script, folded = _script(said), said.casefold()
    return f"{gender if ' ' in said else _family_gender(gender, script, folded)}:{script}:{folded}"


def _untitled(text: str, named: list[Mention]) -> list[Mention]:
    """Mentions without a title of the family names in `named`, alone or after a given name they have there."""
    families: dict[str, str] = {}
    full: dict[str, str] = {}
    for m in sorted(named, key=lambda m: (m.canonical[:2] == "n:", m.start)):
        said = m.canonical.split(":", 2)[2]
        families.setdefault(said.rpartition(" ")[2], m.entities()[-1][1])
        if " " in said:
            full.setdefault(said, m.canonical)
    out, before = [], None
    for w in WORD.finditer(text):
        folded = w[0].casefold()
        if folded in families and not (before and before[0] in ARTICLES and before.end() + 1 == w.start()):
            at, canonical = w.start(), families[folded]
            if before and before.end() + 1 == at and text[at - 1] == " ":
                both = full.get(f"{before[0].casefold()} {folded}")
                at, canonical = (before.start(), both) if both else (at, canonical)
            out.append(Mention(at, w.end(), "name", canonical, text[at : w.end()]))
        before = w
    return out


def find_entities(text: str) -> list[Mention]:
    """Mentions in order. What differs only in spacing, punctuation or case has one canonical form, so it keeps one surrogate.

    A name found after a title is found without one too in the same text.
    """
    if not text or not TRIGGER.search(text):
        return []
    out = []
    for m in ENTITIES.finditer(text):
        kind = "name" if m.lastgroup == "name" else next(k for k, v in m.groupdict().items() if v is not None)
        said, span = m.group(kind), m.span(kind)
        kind = KINDS.get(kind, kind)
        if kind == "name":
            if not said[0].isupper() or (m["title"].isupper() and not said.isupper()):
                continue
            # Of several titles the first that shows a gender counts.
            genders = [TITLES[t] for t in STACK.findall(m["title"])]
            canonical = _name(next((g for g in genders if g != "n"), "n"), said)
        elif kind == "ip" and ":" in said:
            try:
                canonical = ipaddress.IPv6Address(said).compressed
            except ValueError:
                continue
        elif kind == "email":
            canonical = said.lower()
        elif kind in ("phone", "card", "ssn"):
            canonical = "".join(c for c in said if c.isdigit())
            if kind == "phone":
                # A number without country code has the form of those of country 1.
                canonical = canonical if said.startswith(("+", "0")) or len(canonical) == 11 else f"1{canonical}"
                canonical = f"+{COUNTRY.match(canonical)[0]}:{canonical}"
        elif kind == "iban":
            canonical = said.replace(" ", "")
        else:
            canonical = said
        out.append(Mention(*span, kind, canonical, said))
    named = [m for m in out if m.kind == "name"]
    if not named:
        return out
    # Both lists are in order; a mention that meets a found one is part of it.
    free, at = [], 0
    for m in _untitled(text, named):
        while at < len(out) and out[at].end <= m.start:
            at += 1
        if at == len(out) or m.end <= out[at].start:
            free.append(m)
    return sorted(out + free, key=lambda m: m.start)


class _Stream:
    """Numbers drawn from a keyed digest of (kind, canonical form, attempt)."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed, self.block, self.left = (key, f"{kind}\0{canonical}\0{attempt}".encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            key, what = self.seed
            self.left += hmac.new(key, what + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def shaped(self, text: str) -> str:
        """Letters for letters, digits for digits, all else as it is."""
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None and not text.isdigit()
        out = []
        for c in text:
            if hexadecimal and len(text) >= 16:
                d = "0123456789abcdef"[self.below(16)]
                out.append(d.upper() if text.upper() == text else d)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                d = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(d.upper() if c.isupper() else d)
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The surrogate's canonical form."""
    draw = _Stream(key, kind, canonical, attempt)
    if kind == "email":
        # The host has a surrogate of its own. From the fifth draw on the name grows by a digit a draw: short names cannot run out.
        name, _, host = canonical.rpartition("@")
        return f"{draw.shaped(name + '0' * max(0, attempt - 3))}@{host}"
    if kind == "host":
        head, _, top = canonical.rpartition(".")
        return f"{draw.shaped(head + '0' * max(0, attempt - 3))}.{top}"
    if kind == "secret" and re.fullmatch("AKIA[0-9A-Z]{16}", canonical):
        return "AKIA" + draw.shaped(canonical[4:])
    if kind == "phone":
        country, _, digits = canonical.rpartition(":")
        keep = len(country) - 1 if country else 0
        return f"{country}:" * bool(country) + digits[:keep] + draw.shaped(digits[keep:])
    if kind == "card":
        body = canonical[0] + draw.shaped(canonical[1:-1])
        valid = next(str(d) for d in range(10) if _luhn(body + str(d)) == 0)
        return body + (valid if _luhn(canonical) == 0 else str((int(valid) + 1 + draw.below(9)) % 10))
    if kind == "ssn":
        return draw.shaped(canonical)
    if kind == "iban":
        body = draw.shaped(canonical[4:])
        number = "".join(str(int(c, 36)) for c in body + canonical[:2] + "00")
        return f"{canonical[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "ip" and ":" in canonical:
        # Groups that are 0 stay so, and a private or link-local address keeps its first group.
        groups = [int(g, 16) for g in ipaddress.IPv6Address(canonical).exploded.split(":")]
        private = groups[0] >> 9 == 0x7E or groups[0] >> 6 == 0x3FA
        new = [g if g == 0 or (i == 0 and private) else 0x2000 + draw.below(0x1000) if i == 0 else 1 + draw.below(0xFFFF) for i, g in enumerate(groups)]
        # Addresses of few groups cannot run out: later draws fill the last ones.
        new = [g or (1 + draw.below(0xFFFF) if i >= 8 - attempt // 4 else 0) for i, g in enumerate(new)]
        return ipaddress.IPv6Address(":".join(f"{g:x}" for g in new)).compressed
    if kind == "ip":
        private = re.match(r"10\.|192\.168\.|127\.", canonical)
        head = private[0] if private else ""
        if head == "192.168." and attempt > 3:
            head = "10."  # the larger private range, so that addresses cannot run out
        return head + ".".join(str((1 if i == 0 and not head else 0) + draw.below(223)) for i in range(4 - head.count(".")))
    if kind in ("name", "given"):
        gender, script, said = canonical.split(":", 2)
        starts = STARTS[script]
        # A syllable more every other draw: names cannot run out either.
        syllables = "".join(starts[draw.below(len(starts))] for _ in range(2 + attempt // 2))
        given = (starts[draw.below(len(starts))], GIVEN_ENDS[script, gender])
        family = (syllables, FAMILY_ENDS.get((script, gender), FAMILY_ENDS[script, "m"]))
        parts = [(syllables, GIVEN_ENDS[script, gender])] if kind == "given" else [given, family] if " " in said else [family]
        words = [(a + e[draw.below(len(e))]).capitalize() for a, e in parts]
        return f"{gender}:{script}:{' '.join(words)}"
    return draw.shaped(canonical)


def rendered(mention: Mention, chosen: list[str]) -> str:
    """The surrogates of a mention's entities in its format."""
    if mention.kind in ("phone", "card", "ssn", "iban"):
        drawn, n = chosen[0].rpartition(":")[2], sum(c.isalnum() for c in mention.text)
        digits = iter(drawn[len(drawn) - n :])
        return "".join(next(digits) if c.isalnum() else c for c in mention.text)
    if mention.kind == "name":
        words = zip(mention.text.split(" "), (c.split(":", 2)[2] for c in chosen), strict=True)
        return " ".join(new.upper() if old.isupper() else new for old, new in words)
    if mention.kind == "email":
        address = f"{chosen[1].rpartition('@')[0]}@{chosen[0]}"
        return address.upper() if mention.text.isupper() else address
    return chosen[0].upper() if ":" in mention.canonical and mention.kind == "ip" and mention.text.isupper() else chosen[0]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = {e for text in batch["text"].to_pylist() for m in find_entities(text) for e in m.entities()}
        if rows:
            kinds, forms = zip(*sorted(rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(forms)], ["kind", "canonical"])


def _draw(key: bytes):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("kind", "canonical", "attempt")]
            drawn = pa.array([surrogate(key, *row) for row in zip(*columns, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("kind", "canonical", "attempt")), drawn], ["kind", "canonical", "attempt", "drawn"])

    return each


def _form(kind: Column, canonical: Column) -> Column:
    """What a reader sees of a canonical form: names without gender and script, in one case; digits without the country."""
    name = F.translate(F.lower(F.regexp_replace(canonical, "^[^:]*:[^:]*:", "")), "ς", "σ")
    return F.when(kind.isin("name", "given"), name).when(kind == "phone", F.regexp_replace(canonical, "^.*:", "")).otherwise(canonical)


def assign_surrogates(entities: DataFrame, key: bytes = DEMO_KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canonical, attempt, drawn): distinct entities with surrogates no two of them share, none of them an entity itself.

    All draw at once; of those that drew what reads the same, the first keeps
    it and the others draw again, until all are settled. Every round is a join
    of keys.
    """
    known = cut_lineage(entities.select("kind", "canonical").distinct())
    taken = cut_lineage(known.select("kind", _form(F.col("kind"), F.col("canonical")).alias("form")).distinct())
    settled, open_ = None, known.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        drawn = open_.mapInArrow(_draw(key), "kind string, canonical string, attempt int, drawn string")
        drawn = cut_lineage(drawn.withColumn("form", _form(F.col("kind"), F.col("drawn"))))
        firsts = drawn.groupBy("kind", "form").agg(F.min("canonical").alias("canonical"))
        free = firsts.join(taken, ["kind", "form"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "form"], "left_anti")
        kept = cut_lineage(drawn.join(free, ["kind", "form", "canonical"]).select(drawn.columns))
        settled = kept if settled is None else settled.unionByName(kept)
        open_ = drawn.join(kept.select("kind", "canonical"), ["kind", "canonical"], "left_anti").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return settled.drop("form")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def _redrawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, kind, canonical) of every distinct mention, for texts with any."""
    for batch in pieces(batches):
        rows = []
        for h1, h2, text in zip(*(batch[c].to_pylist() for c in ("_h1", "_h2", "text")), strict=True):
            rows += [(h1, h2, *e) for e in {e for m in find_entities(text) for e in m.entities()}]
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_h1", "_h2", "kind", "canonical"])


def _looked_up(assigned: DataFrame) -> DataFrame:
    """(kind, canonical, drawn) of entities that a task cannot draw by itself.

    These are those drawn again, and given names after a title of no gender
    that some text has after one of a gender: the person keeps that surrogate.
    """
    said = F.regexp_replace("canonical", "^[^:]*:", "")
    given = cut_lineage(assigned.where("kind = 'given'").select("canonical", "drawn", said.alias("said")))
    twins = given.where("canonical not like 'n:%'").groupBy("said").agg(F.min_by("drawn", "canonical").alias("drawn"))
    twins = cut_lineage(given.where("canonical like 'n:%'").drop("drawn").join(twins, "said").select(F.lit("given").alias("kind"), "canonical", "drawn"))
    return assigned.where("attempt > 0").select("kind", "canonical", "drawn").join(twins, ["kind", "canonical"], "left_anti").unionByName(twins)


def replace_personal_data(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """`docs` with `text_col` rewritten and `count_col`, the number of mentions replaced; all columns and rows stay.

    E-mail addresses, secrets after their name, access keys, IBANs, IPv4 and
    IPv6 addresses, phone numbers, social security numbers, card numbers and
    names after one or more titles are replaced, and those names without one in
    the same text. Given and family names and the hosts of addresses have
    surrogates of their own; names that never have a title are not found. The same entity gets the same surrogate in
    every document and format, different ones get different ones. A surrogate
    keeps country code, top domain, Luhn and check-digit validity, letter case,
    separators, script and gender. Null texts stay null. A column already
    named `count_col` is replaced.

    Surrogates are computed where the text is; only those drawn again after a
    collision are looked up, by a join on the text's hash.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    entities = texts.mapInArrow(_entities, "kind string, canonical string")
    assigned = assign_surrogates(entities, key)
    again = cut_lineage(_looked_up(assigned))
    hashes = {"_h1": F.xxhash64("text"), "_h2": F.hash("text")}
    keep = [c for c in docs.columns if c.lower() != count_col.lower()]
    # No mention is listed at all when nothing was drawn again.
    if again.limit(1).count():
        mentions = texts.withColumns(hashes).mapInArrow(_redrawn, "_h1 long, _h2 int, kind string, canonical string").distinct()
        looked_up = mentions.join(again, ["kind", "canonical"]).groupBy("_h1", "_h2").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "canonical"), "drawn"))).alias("_again")
        )
        rows = docs.select(*keep, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h1"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("_h2"))
        rows = rows.join(bounded(looked_up), ["_h1", "_h2"], "left").select(*keep, "_again")
    else:
        rows = docs.select(*keep, F.lit(None).cast("map<string,string>").alias("_again"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            texts, counts = [], []
            for text, redrawn in zip(batch["_text"].to_pylist(), batch["_again"].to_pylist(), strict=True):
                known, found, parts, at = dict(redrawn or ()), find_entities(text), [], 0
                for m in found:
                    chosen = [known.get("\0".join(e)) or surrogate(key, *e) for e in m.entities()]
                    parts += [text[at : m.start], rendered(m, chosen)]
                    at = m.end
                texts.append("".join(parts) + text[at:] if found else text)
                counts.append(len(found))
            none = batch[text_col].is_null()
            arrays = [pc.if_else(none, pa.scalar(None, pa.string()), pa.array(texts, pa.string())) if c == text_col else batch[c] for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], [*keep, count_col])

    schema = docs.select(*keep).schema.add(count_col, "long")
    return rows.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), "_again").mapInArrow(each, schema)


@query()
def op4_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with personal data replaced."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return replace_personal_data(docs)
