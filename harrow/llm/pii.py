"""Personal data by weak supervision, in DataFrame expressions only.

Base spans are fixed patterns with checks; they always stay. Further candidates
(phone numbers without a country code, spelled-out e-mail addresses, keys and
tokens, bank account numbers, social security numbers, names of persons) are
decided by labelers, each of which votes for, against or not at all: the pattern's
own form (its check digits, its alphabet), a gazetteer (mail domains, number
prefixes, reserved blocks, countries, given names), words of the context that
speak for the kind, words that speak against. No labeler decides alone, and equal
votes for and against leave it to what expectation maximisation and the kind's own
frequency say. Expectation
maximisation over the counts of vote patterns estimates how often each labeler
says what for true and for false spans; the posteriors then train the final
classifier, a logistic regression on votes and kind, which judges every
candidate. Vote patterns are at most a few hundred whatever the input, so only
their counts reach the driver.

Positions come without a loop over characters: matches are put between two
private-use signs, the text is split there, and a running sum of the part
lengths is each match's place. The sign itself in a text is first replaced by
another of the same length. Only part lengths, matches and a few characters
around them are kept, never the text.

Patterns never look at one stretch of characters twice: quantifiers are
possessive and a match starts a stretch or follows the match before. Base spans may
have any length; of the candidates beside them a key has 20 to 128 characters, and the
parts of a spelled-out address at most 64: what is longer is no candidate.

Defined cases: null and empty texts have no spans; null ids are kept; repeated
rows are reported each; spans of different kinds may overlap; an added span never
overlaps a base span; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

SIGN, OTHER_SIGN = "\ue000", "\ue001"
#: Kinds of base spans, and kinds that only the method adds.
KINDS, ADDED = ["email", "ip", "card", "phone"], ["secret", "iban", "ssn", "name"]
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Given names that a name of a person may start with, and country codes of bank account numbers.
GIVEN = (
    "Alice|Andrew|Anna|Anne|Antonio|Barbara|Benjamin|Carlos|Carmen|Charles|Christina|Claire|Daniel|David|Deborah|Edward|Elena|Elizabeth|Emily|Emma|Eric|Fatima|Francesca|Frank|George|Hannah|Hans|Heinrich|Helen|Isabel|"
    "Jacques|James|Jane|Jean|Jennifer|Jessica|Johann|John|Jonathan|Jose|Joseph|Juan|Julia|Karen|Katharina|Kevin|Klaus|Laura|Linda|Lisa|Louise|Lucia|Luis|Margaret|Maria|Marie|Martin|Mary|Matthew|Michael|Miguel|Mohammed|"
    "Nancy|Nicolas|Nicole|Olivia|Patricia|Paul|Peter|Philippe|Pierre|Rachel|Richard|Robert|Ryan|Sandra|Sarah|Sophie|Stefan|Stephen|Steven|Susan|Teresa|Thomas|Ursula|Victoria|William|Wolfgang"
)
COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.? "
#: The start of a capitalised word; asked first, so that names are compared at such places only.
CAPITAL = r"(?=[A-Z])(?<![A-Za-z])"
#: Candidates beside the base, by the kind they would be.
LOOSE = {
    "secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]{0,127}+[0-9])(?=[0-9+/_-]{0,127}+[A-Za-z])[A-Za-z0-9+/_-]{20,128}+={0,2}(?![A-Za-z0-9+/_=@-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"{CAPITAL}(?:(?:{TITLE})(?:[A-Z][a-zà-ÿ]+ )?|(?:{GIVEN}) )(?:[A-Z]\. )?[A-Z][a-zà-ÿ]+(?:-[A-Z][a-zà-ÿ]+)?(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z@]|[.-][0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,5}",
}
#: What a text must hold to have a match at all.
NEEDS = {"email": "@", "phone+": "[0-9]{4}", "email+": "(?:[\\[(]at[\\])])", "secret+": "[A-Za-z0-9+/_-]{20}", "iban+": "[A-Z]{2}[0-9]{2}", "ssn+": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "name+": rf"{CAPITAL}(?:{TITLE}|(?:{GIVEN}) )"}
AROUND = 40
#: Gazetteers and context words.
MAIL_ENDS = r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|co|us)$"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
OWN_NETS = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
FOR = {
    "email": r"(?i)\b(?:e-?mails?|contact|write|reach|mailto|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|call|tel|telephone|mobile|cell|fax|text|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    "secret": r"(?i)(?:token|secret|passw|api.?key|access.?key|private.?key|bearer|auth|credential)",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|taxpayer)\b",
    "name": r"(?i)\b(?:name|dear|signed|sincerely|regards|patient|customer|contact|attn|author|from|by|named|born)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|ticket|section|figure|table|page|serial|build|commit|checksum|sha1|sha256|md5|etag|hash|street|avenue|university|saint)\b[^\n]{0,12}$"
VOTERS = ["form", "gazetteer", "context", "against"]


def _parts(text: Column, pattern: str) -> Column:
    """What lies between and in the matches, alternately: length, match, and the ends of what lies between."""
    marked = F.split(F.regexp_replace(text, pattern, f"{SIGN}$0{SIGN}"), SIGN)
    return F.transform(marked, lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, x).alias("match"), F.when(i % 2 == 0, F.right(x, F.lit(AROUND))).alias("ends")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def _mod97(match: Column) -> Column:
    """Whether an account number's check digits are right: moved to the end, letters as 10 to 35, modulo 97 it is 1."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(9, 15))
    )


def _votes(kind: Column, match: Column, before: Column) -> dict[str, Column]:
    digits = _digits(match)
    cue = F.lit(False)
    for k, words in FOR.items():
        cue = cue | ((kind == k) & before.rlike(words))
    known = (
        F.when(kind == "email", match.rlike(MAIL_ENDS))
        .when(kind == "ip", ~match.rlike(OWN_NETS))
        .when(kind == "card", digits.rlike(CARD_STARTS))
        .when(kind == "secret", match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-.*)$") | (match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9].*[0-9].*[0-9]") & ~match.contains("/")))
        .when(kind == "iban", match.rlike(f"^(?:{COUNTRIES})"))
        .when(kind == "ssn", ~match.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "name", match.rlike(f"(?:{GIVEN}) "))
        .otherwise(~digits.rlike(r"^(?:0{3}|1{3})|(?:0{7}|1234567)$"))
    )
    form = F.when(F.col("base"), F.when(F.col("valid"), 1).otherwise(-1)).otherwise(F.when((kind == "phone") & match.rlike(r"^\(?[0-9]{3}\)?[ .-]555|^\([0-9]{3}\) "), 1).when(kind == "email", 1)
        .when(kind == "secret", F.when(match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | match.rlike("^(?:AKIA|gh[pousr]_|sk-)"), 1).when(match.rlike("[/]|[A-Za-z]{12}|--"), -1).otherwise(0))
        .when(kind == "iban", F.when(_mod97(match), 1).otherwise(-1))
        .when((kind == "name") & match.rlike(f"^{TITLE}"), 1).otherwise(0))
    return {
        "form": form,
        "gazetteer": F.when(known, 1).otherwise(-1),
        "context": F.when(cue, 1).otherwise(0),
        "against": F.when(before.rlike(AGAINST), -1).otherwise(0),
    }


def reliabilities(counts: dict[tuple[int, ...], int], steps: int = 50) -> tuple[float, list, dict[tuple[int, ...], float]]:
    """Expectation maximisation over vote patterns.

    Returns the share of true spans, P(vote | truth) for each labeler, and the
    posterior of each pattern. Starts from the majority vote; add-one smoothing.
    """
    post = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in counts}
    share, table_ = 0.5, []
    for _ in range(steps):
        total = sum(counts.values())
        share = (1 + sum(n * post[v] for v, n in counts.items())) / (2 + total)
        table_ = []
        for j in range(len(VOTERS)):
            both = []
            for truth in (0, 1):
                of = {x: 1.0 for x in (-1, 0, 1)}
                for v, n in counts.items():
                    of[v[j]] += n * (post[v] if truth else 1 - post[v])
                both.append({x: c / sum(of.values()) for x, c in of.items()})
            table_.append(both)
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(table_[j][1][x] / table_[j][0][x]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, table_, post


def fit(rows: list[tuple[tuple[float, ...], float, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression by gradient steps on (features, soft label, count); the bias comes last."""
    if not rows:
        return []
    width = len(rows[0][0])
    w, total = [0.0] * (width + 1), sum(n for _, _, n in rows)
    for _ in range(steps):
        g = [decay * x for x in w[:-1]] + [0.0]
        for x, y, n in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            for j, a in enumerate(x):
                g[j] += e * a
            g[-1] += e
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def find(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, spans array<struct<k, start, end, base, score>> in order of kind and start."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), SIGN, OTHER_SIGN)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("tag"))
    patterns = {k: p for k, p in BASE.items()} | {f"{k}+": p for k, p in LOOSE.items()}
    found = [F.struct(F.lit(k.rstrip("+")).alias("kind"), F.lit("+" not in k).alias("base"), F.when(F.col("text").rlike(NEEDS.get(k, "[0-9]")), _parts(F.col("text"), p)).alias("parts")) for k, p in patterns.items()]
    held = cut(rows.select("id", "tag", F.filter(F.array(*found), lambda x: F.size(x["parts"]) > 1).alias("found")))
    each = held.select("tag", F.explode("found").alias("f")).select("tag", "f.kind", "f.base", F.posexplode("f.parts").alias("at", "part"))
    order = Window.partitionBy("tag", "kind", "base").orderBy("at")
    placed = each.select("tag", "kind", "base", "at", "part", (F.sum("part.n").over(order) - F.col("part.n")).alias("start"), F.lag("part.ends").over(order).alias("before")).filter(F.col("part.match").isNotNull())
    spans = placed.select("tag", "kind", "base", F.col("part.match").alias("match"), "start", (F.col("start") + F.col("part.n")).alias("end"), F.coalesce("before", F.lit("")).alias("before"))
    spans = spans.withColumn("valid", F.when(F.col("base"), _valid(F.col("kind"), F.col("match"))).otherwise(True))
    # both windows run from one end on: each row adds itself to what was before
    sides = ["start", "end", "kind", "base"]
    ahead, back = Window.partitionBy("tag").orderBy(*sides), Window.partitionBy("tag").orderBy(*map(F.desc, sides))
    kept = F.col("base") & F.col("valid")
    spans = spans.withColumns({
        "left": F.max(F.when(kept, F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1)),
        "right": F.min(F.when(kept, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    free = (F.coalesce("left", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("right") >= F.col("end"), F.lit(True))
    spans = spans.filter(F.col("base") | free)
    # a base candidate that failed its check tells the labelers' reliabilities but is never reported
    spans = cut(spans.select("tag", "kind", "base", "valid", "start", "end", *[v.cast("int").alias(f"v_{n}") for n, v in _votes(F.col("kind"), F.col("match"), F.col("before")).items()]))
    votes = [f"v_{n}" for n in VOTERS]
    counted = spans.groupBy("kind", *votes).count().collect()  # at most kinds x 3^voters rows
    by_pattern: dict[tuple[int, ...], int] = {}
    for r in counted:
        v = tuple(r[c] for c in votes)
        by_pattern[v] = by_pattern.get(v, 0) + r["count"]
    _, _, post = reliabilities(by_pattern)
    weights = fit([((*(float(r[c]) for c in votes), *(float(r["kind"] == k) for k in [*KINDS, *ADDED])), post[tuple(r[c] for c in votes)], r["count"]) for r in counted])
    z = F.lit(weights[-1] if weights else 0.0)
    for w, x in zip(weights, [*(F.col(c) for c in votes), *((F.col("kind") == k).cast("int") for k in [*KINDS, *ADDED])], strict=False):
        z = z + x * F.lit(w)
    number = F.array_position(F.array(*map(F.lit, [*KINDS, *ADDED])), F.col("kind")).cast("int") - 1
    judged = spans.withColumn("score", 1 / (1 + F.exp(-z))).filter(F.when(F.col("base"), F.col("valid")).otherwise(F.col("score") >= threshold))
    per = judged.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct(number.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base", "score"))).alias("spans"))
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint,base:boolean,score:double>>")
    return held.select("id", "tag").join(per, "tag", "left").select("id", F.coalesce("spans", none).alias("spans"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, [*KINDS, *ADDED])), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter(base, lambda s: s["k"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
