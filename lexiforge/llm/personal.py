r"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

All DataFrame functions. A text is cut by a kind's pattern and running sums of the parts' lengths give the places, so a
pattern runs only over texts that hold its signs. Arrays are worked on in groups of ``GROUP``, groups of groups and so on, so
the time grows with the text and its spans, however many there are in one text. Patterns are written without nested repetition that could overflow the matcher
on very long texts: what the base definitions match greedily is matched possessively, and a run is tried once, from its start.

Kinds: email, ip (parts up to 255), card (Luhn), phone (9 to 15 digits) are always reported; iban (length by country, mod 97) and ssn (three
number groups in valid ranges, with a word such as "social security" near) are added by this method. Null text is empty;
rows are scanned one by one, whole, so ties and repeats need no rule; an empty table gives no rows. ``scan_personal`` ignores
extra columns, ``masked`` returns them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.licences import bind

NEAR = 40  # characters before a span in which context words count, back to the kind's last span but one
GROUP, LEVELS = 64, 2


@dataclass(frozen=True)
class Kind:
    """guard: a cheap pattern without which the kind cannot occur. context: words that raise the score."""

    name: str
    guard: str
    pattern: str
    context: str
    prior: float
    least: float = 0.0


#: Characters of an account number by country; numbers of other countries are matched as far as they go.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(IBAN_LENGTHS.values()).split())
_IBAN = "|".join([
    *(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()),
    rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_LISTED})[0-9]{{2}}) ?[A-Z0-9]){{11,30}}",
])

KINDS = (
    Kind("email", r"@[A-Za-z0-9-]", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"mail|contact|write|reply", 0.8),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\bip\b|address|host|server|login", 0.5),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", r"card|visa|master|credit|debit|pay", 0.8),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"phone|tel|call|mobile|fax|whatsapp", 0.6),
    Kind("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", r"iban|account|bank|konto|compte|cuenta", 0.8),
    Kind("ssn", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"\bssn\b|social security|tax", 0.4, 0.6),
)
BASE = 4  # the first so many kinds


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled and cast out by nines, and the others sum to a multiple of 10."""
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number with its head moved behind, letters read as 10 to 35, leaves 1 modulo 97."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(name: str, match: Column) -> Column:
    if name == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if name == "card":
        return luhn(_digits(match))  # the pattern admits 13 to 19 digits
    if name == "phone":
        return F.length(_digits(match)).between(9, 15)
    if name == "iban":
        return mod97(match)
    if name == "ssn":
        return ~F.rlike(match, F.lit(r"^(?:000|666|9)|-00-|-0000$"))
    return F.lit(True)


def groups_of(values: Column, size: int) -> Column:
    """The array cut to arrays of ``size``; null for an empty one. A slice reads its whole array, so it is first cut to larger groups."""
    def cut(some: Column, length: int) -> Column:
        n = F.ceil(F.size(some) / length).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(some, i * length + 1, F.lit(length))))

    return F.flatten(F.transform(cut(values, size * GROUP), lambda g: cut(g, size)))


def before(values: Column, combine, levels: int = LEVELS) -> Column:
    """For each of the whole numbers what ``combine`` makes of all before it, from 0: each group by itself, from what came before the group."""
    def fold(some: Column, start: Column) -> Column:
        first = F.struct(start.alias("so_far"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(combine(a["so_far"], x).alias("so_far"), F.concat(a["out"], F.array(a["so_far"])).alias("out"))
        return F.aggregate(some, first, step)["out"]

    if not levels:
        return fold(values, F.lit(0))

    def whole(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), combine))
        return F.flatten(F.zip_with(groups, before(totals, combine, levels - 1), fold))

    return F.when(F.size(values) > 0, bind(groups_of(values, GROUP), whole)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> in order of start; code points, end exclusive."""
    cut = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))

    def place(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: F.length(g) + F.length(h))

        def span(at: Column, i: Column) -> Column:
            gap, hit = F.get(x["gaps"], i), F.get(x["hits"], i)
            start = at + F.length(gap)
            last = F.when(i > 0, F.concat(F.get(x["gaps"], i - 1), F.get(x["hits"], i - 1))).otherwise(F.lit(""))
            value = score(kind, F.when(F.length(gap) < NEAR, F.concat(last, gap)).otherwise(gap))
            return F.when(confirmed(kind.name, hit) & (value >= kind.least), F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), value.alias("score")))

        return F.filter(F.transform(before(sizes, lambda a, n: a + n), span), lambda s: s.isNotNull())

    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    return F.when(F.rlike(text, F.lit(kind.guard)), bind(cut, place)).otherwise(none)


def score(kind: Kind, ahead: Column) -> Column:
    """The kind's prior, and half of what is missing to 1 if a context word stands at the end of what is ahead of the span."""
    near = F.lower(F.right(ahead, F.lit(NEAR)))
    return F.when(F.rlike(near, F.lit(kind.context)), F.lit(kind.prior + (1 - kind.prior) / 2)).otherwise(F.lit(kind.prior))


def _listed(spans: Column, kind: Kind) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"]))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans for each kind."""
    return docs.select("doc_id", bind(F.coalesce("text", F.lit("")), lambda t: F.struct(*[spans_of(t, k).alias(k.name) for k in KINDS])).alias("found"))


def scan_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, best_score for each row of docs (doc_id, text)."""
    def digest(f: Column) -> Column:
        base = F.array_join(F.concat(*[_listed(f[k.name], k) for k in KINDS[:BASE]]), ",")
        every = F.array_join(F.concat(*[_listed(f[k.name], k) for k in KINDS]), ",")
        best = F.array_max(F.concat(*[F.transform(f[k.name], lambda s: s["score"]) for k in KINDS]))
        counts = [F.size(f[k.name]).cast("long").alias(f"n_{k.name}") for k in KINDS[:BASE]]
        return F.struct(*counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.coalesce(best, F.lit(0.0)).alias("best_score"))

    return found_spans(docs).select("doc_id", bind(F.col("found"), digest).alias("d")).select("doc_id", "d.*")


def written(text: Column, pieces: Column, start: Column, levels: int = LEVELS) -> Column:
    """Text from ``start`` on in which each piece (from, to, mark) is the text from ``from`` to ``to``, then the mark."""
    if not levels:
        return F.array_join(F.transform(pieces, lambda p: F.concat(F.substring(text, p["from"] - start + 1, p["to"] - p["from"]), p["mark"])), "")

    def part(group: Column) -> Column:
        first, last = F.get(group, F.lit(0))["from"], F.element_at(group, -1)["to"]
        return bind(F.substring(text, first - start + 1, last - first), lambda t: written(t, group, first, levels - 1))

    return F.array_join(F.transform(groups_of(pieces, GROUP**levels), part), "")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets; overlapping spans become one. n_chars follows."""
    text = F.col("row.text")

    def marked(kind: Kind) -> Column:
        return F.transform(spans_of(text, kind), lambda s: F.struct(s["start"], s["end"], F.lit(f"<{kind.name.upper()}>").alias("mark")))

    # steps of their own: one expression of all would be nested too deep
    found = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.array_sort(F.concat(*map(marked, KINDS))).alias("spans"))
    ends = F.transform("spans", lambda s: s["end"])
    # each span hides what no span before it hides; the text between goes before its mark
    piece = lambda s, to: F.struct(to.alias("from"), F.greatest(s["start"], to).alias("to"), F.when(s["start"] >= to, s["mark"]).otherwise("").alias("mark"))
    hidden = found.select("row", F.array_max(ends).alias("end"), F.zip_with("spans", before(ends, lambda a, n: F.greatest(a, n)), piece).alias("pieces"))
    whole = F.when(F.size("pieces") > 0, F.concat(written(text, F.col("pieces"), F.lit(0)), F.substr(text, F.col("end") + 1))).otherwise(text)
    told = hidden.select("row", whole.alias("whole"))
    changed = {"text": F.col("whole"), "n_chars": F.length("whole").cast("long")}
    return told.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
