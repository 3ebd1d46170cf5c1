"""Company names: the comparison core, whether it identifies, and the rules that match two cores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, which carry no identity.
LEGAL = (
    "inc incorporated corp corporation corporations co company companies ltd ltda limited llc lp llp plc the sa sas nv ag as ab oyj oy gmbh mbh kg kgaa kk aps "
    "spa srl bv pte pty pvt private holdings holding group groupe et al and of a"
).split()
# Words too common to identify a company on their own.
STOPWORDS = (
    "new first one two united general national advanced applied select premier prime next core pure true smart clear focus vision access summit capital north south "
    "east west central alliance network point path bridge spring phase trial study clinical cell cells gene genes protein molecular immune neuro cardio derma vascular "
    "surgical care life living human world health medical medicine pharma pharmaceutical pharmaceuticals therapeutics biosciences science sciences labs laboratories "
    "research global international america american usa technologies technology systems solutions products industries biotech biotechnology genomics genetics "
    "diagnostics devices oncology biologics bio medicines immunotherapeutics biopharma biopharmaceutical biopharmaceuticals biotherapeutics wellness nutrition "
    "immunotherapy vaccines"
).split()
# Fixed value: what registrant lists append to names.
ARTEFACT = r"(?i)[\\/][a-z]{2,4}[\\/]?\s*$|\bet\s+al\b"
#: The rules from the strongest claim to the weakest.
RULES = ("R1", "R2", "R3", "R3b")


def _words(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in sorted(set(words))))


def core(name: Column) -> Column:
    """Lower case, `&` as and, registrant artefacts out, split at all but letters and digits, legal forms out."""
    s = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, ARTEFACT, " ")
    legal = _words(LEGAL)
    return F.array_join(F.filter(F.split(s, "[^a-z0-9]+"), lambda t: (t != "") & ~F.array_contains(legal, t)), " ")


def usable(c: Column, extra_stopwords: Iterable[str] = ()) -> Column:
    """Not empty, and if a single word: five letters or more, no stopword, not a number."""
    alone = (F.length(c) >= 5) & ~F.array_contains(_words([*STOPWORDS, *extra_stopwords]), c) & ~c.rlike("^[0-9]+$")
    return (c != "") & (c.contains(" ") | alone)


def rule(a: Column, b: Column, extra_stopwords: Iterable[str] = ()) -> Column:
    """R1: equal. R2: a single word with at most two letters added. R3: the other has at most two
    words more. R3b: the other lacks only words that may go. Null: no match. All but R2 need the same first word."""
    stop = _words([*STOPWORDS, *extra_stopwords])
    at, bt = F.split(a, " "), F.split(b, " ")
    aset, bset = F.array_distinct(at), F.array_distinct(bt)
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    more = F.length(long_) - F.length(short)
    tag = (F.size(at) == 1) & (F.size(bt) == 1) & long_.startswith(short) & (F.length(short) >= 6) & more.between(1, 2) & (F.length(short) >= 0.70 * F.length(long_))

    def alone(words: Column) -> Column:
        return (F.size(words) >= 2) | ((F.length(words[0]) >= 6) & ~F.array_contains(stop, words[0]))

    a_only, b_only = F.array_except(aset, bset), F.array_except(bset, aset)
    plus = (F.size(a_only) == 0) & F.size(b_only).between(1, 2) & alone(aset)
    minus = (F.size(b_only) == 0) & (F.size(a_only) > 0) & alone(bset) & F.forall(a_only, lambda t: (F.length(t) <= 2) | F.array_contains(stop, t))
    return F.when(a == b, "R1").when(tag, "R2").when(at[0] != bt[0], None).when(plus, "R3").when(minus, "R3b")


def stays(c: Column, extra_stopwords: Iterable[str] = ()) -> Column:
    """The distinct words of a core that may not go under R3b, sorted."""
    stop = _words([*STOPWORDS, *extra_stopwords])
    return F.array_sort(F.filter(F.array_distinct(F.split(c, " ")), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


def rule_keys(c: Column, alias: bool, rarest: Column, extra_stopwords: Iterable[str] = ()) -> Column:
    """Keys of a core such that an alias and a candidate that match under a rule share one, and few others do.

    R1: the core. R2: the shorter word against the longer one less one or two letters, either way
    round. R3: the first word and the alias's set of words, against the candidate's set less one or
    two of its other words. R3b: the first word, the words that may not go, and a candidate's `rarest` word, which the alias must have too,
    against each of the alias's words: names that only common words make up do not all meet on one key."""
    words = F.split(c, " ")
    first, own = words[0], F.array_sort(F.array_distinct(words))
    key = lambda tag, *parts: F.concat_ws("|", F.lit(tag), *parts)
    less = lambda n: F.substring(c, 1, F.length(c) - n)
    shorter, longer = ("2a", "2c") if alias else ("2c", "2a")
    single = F.size(words) == 1
    one = [F.when(single & (F.length(c) >= 6), key(shorter, c)), *(F.when(single & (F.length(c) >= 6 + n), key(longer, less(n))) for n in (1, 2))]
    if alias:
        sets = F.array(key("3", first, F.array_join(own, " ")))
        kept = F.transform(own, lambda t: key("3b", first, F.array_join(stays(c, extra_stopwords), " "), t))
    else:
        rest = F.filter(own, lambda t: t != first)
        cut = F.flatten(F.transform(rest, lambda x: F.transform(F.filter(rest, lambda y: y >= x), lambda y: F.filter(own, lambda t: (t != x) & (t != y)))))
        sets = F.transform(cut, lambda s: key("3", first, F.array_join(s, " ")))
        kept = F.array(key("3b", first, F.array_join(stays(c, extra_stopwords), " "), rarest))
    return F.array_distinct(F.concat(F.array_compact(F.array(key("1", c), *one)), kept, sets))
