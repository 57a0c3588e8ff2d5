"""Scalar operators on words as Column functions: no Python runs on the executors."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import seeds as S


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def round_n(c: Column, n: int) -> Column:
    """Rounds half up; the same in any engine for scores that aren't negative."""
    return F.floor(c * 10**n + 0.5) / float(10**n)


def normalise(c: Column) -> Column:
    return F.lower(strip(c))


def unstar(c: Column) -> Column:
    return F.regexp_replace(c, r"^\*+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def holds(c: Column, parts) -> Column:
    """Whether the text holds one of the parts as it is written."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts], F.lit(False))


def filled(template: str, *values: Column) -> Column:
    """The template with each {} replaced by the next value."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def letters(c: Column, alphabet: str) -> Column:
    return F.regexp_replace(unstar(F.lower(c)), f"[^{alphabet}]", "")


def script(c: Column) -> Column:
    return F.when(c.rlike("[Ѐ-ӿ]"), "Cyrillic").when(c.rlike("[؀-ۿ]"), "Arabic").when(c.rlike("[Ͱ-Ͽ]"), "Greek").otherwise("Latin")


def to_latin(c: Column) -> Column:
    """Cyrillic and Arabic letters in Latin ones, capitals kept; other signs stay, and so does a text without either script."""
    table = S.CYRILLIC_LATIN | {k.upper(): v.upper() for k, v in S.CYRILLIC_LATIN.items()} | S.ARABIC_LATIN
    single = {k: v for k, v in table.items() if len(v) == 1}
    dropped = [k for k, v in table.items() if not v]
    plain = F.translate(c, "".join(single) + "".join(dropped), "".join(single.values()))
    spelled = reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), [(k, v) for k, v in table.items() if len(v) > 1], plain)
    return F.when(c.rlike("[Ѐ-ӿ؀-ۿ]"), spelled).otherwise(c)


def translate_meaning(c: Column) -> Column:
    """A meaning by the first English key that it holds, else bare of templates and link brackets; placeholders and null stay."""
    m = strip(c)
    bare = strip(F.regexp_replace(strip(F.regexp_replace(m, r"\{\{.*?\}\}", "")), r"\[\[(.*?)\]\]", "$1"))
    known = F.coalesce(*[F.when(F.contains(F.lower(bare), F.lit(k)), F.lit(v)) for k, v in S.MEANINGS])
    return F.when((m == "") | F.startswith(m, F.lit("Online")), m).otherwise(F.coalesce(known, F.nullif(bare, F.lit("")), c))


def timeline(entries: Column, repeats: bool = False) -> Column:
    """A line for each entry whose language name tells a period, in the entries' order, each line once unless ``repeats`` are asked for."""

    def line(e: Column) -> Column:
        name, word = e["lang_name"], e["word"]
        (k1, t1), *rest = S.TIMELINE
        told = F.when(holds(name, k1), F.concat(F.lit(t1), word, F.lit(" - "), F.substring(e["meaning"], 1, 60)))
        return reduce(lambda acc, kt: acc.when(holds(name, kt[0]), F.concat(F.lit(kt[1]), word)), rest, told)

    lines = F.filter(F.transform(entries, line), F.isnotnull)
    return lines if repeats else F.array_distinct(lines)


def first_record(word: Column, entries: Column | None = None) -> Column:
    """The record that the first telling entry stands for, else a sentence on the word."""
    default = filled(S.NO_RECORD, word)
    if entries is None:
        return default
    told = lambda e: F.coalesce(*[F.when(holds(e["lang_name"], names) | holds(e["meaning"], senses), F.lit(text)) for names, senses, text in S.RECORDS])
    return F.coalesce(F.get(F.filter(F.transform(entries, told), F.isnotnull), F.lit(0)), default)


def related(word: Column, stem: Column, entries: Column) -> Column:
    """At most 12 other words of the entries, each once; fewer than three are filled up with the stem's candidates."""
    key = lambda w: unstar(F.lower(w))
    spelled = F.filter(F.transform(entries, lambda e: strip(e["word"])), lambda w: (key(w) != "") & (key(w) != word))
    keys = F.transform(spelled, key)
    own = F.filter(spelled, lambda w, i: F.array_position(keys, key(w)) == i + 1)
    more = F.filter(candidates(stem), lambda w: (w != word) & ~F.array_contains(keys, w))
    return F.slice(F.when(F.size(own) < 3, F.concat(own, more)).otherwise(own), 1, 12)


def change_names(a: Column, b: Column) -> Column:
    """Names of the shifts between two lower-case words."""
    starts = lambda c, x: F.startswith(c, F.lit(x))
    has = lambda c, x: F.contains(c, F.lit(x))
    cases = [starts(a, "k") & starts(b, "h"), starts(a, "t") & starts(b, "d"), (has(a, "r") & has(b, "l")) | (has(a, "l") & has(b, "r"))]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in zip(cases, S.CHANGES, strict=True)]), F.isnotnull)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(S.NO_CHANGE)))


def first_letter(c: Column) -> Column:
    return F.substring(c, 1, 1)


def strip_suffixes(c: Column) -> Column:
    """struct(stem, affixes): one pass over the suffixes, each cut where three letters stay."""
    empty = F.struct(c.alias("stem"), F.array().cast("array<string>").alias("affixes"))
    fits = lambda a, s: F.endswith(a["stem"], s) & (F.length(a["stem"]) - F.length(s) >= 3)
    cut = lambda a, s: F.struct(F.substr(a["stem"], F.lit(1), F.length(a["stem"]) - F.length(s)).alias("stem"), F.concat(a["affixes"], F.array(F.concat(F.lit("-"), s))).alias("affixes"))
    folded = F.aggregate(strings(S.SUFFIXES), empty, lambda a, s: F.when(fits(a, s), cut(a, s)).otherwise(a))
    return F.when(first_letter(c).isin(S.FOREIGN_INITIALS), empty).otherwise(folded)


def segment(c: Column) -> Column:
    """struct(stem, affixes): the first alternative that leaves two letters, again and again, while three letters stand."""
    w = letters(normalise(c), S.ALPHABET_B)

    def step(a: Column) -> Column:
        stem = a["stem"]
        ends = [(n, [x for x in group if len(x) == n]) for group in S.SEGMENTS for n in sorted({len(x) for x in group}, reverse=True)]
        found = F.coalesce(*[F.when((F.length(stem) >= n + 2) & F.right(stem, F.lit(n)).isin(own), F.right(stem, F.lit(n))) for n, own in ends])
        return F.when(F.length(stem) >= 3, found)

    def cut(a: Column) -> Column:
        found = step(a)
        shorter = F.struct(F.substr(a["stem"], F.lit(1), F.length(a["stem"]) - F.length(found)).alias("stem"), F.concat(F.array(F.concat(F.lit("-"), found)), a["affixes"]).alias("affixes"), F.lit(False).alias("done"))
        return F.when(a["done"], a).when(found.isNotNull(), shorter).otherwise(F.struct(a["stem"].alias("stem"), a["affixes"].alias("affixes"), F.lit(True).alias("done")))

    start = F.struct(w.alias("stem"), F.array().cast("array<string>").alias("affixes"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(w) / 2)), start, lambda a, _: cut(a), lambda a: F.struct(a["stem"].alias("stem"), a["affixes"].alias("affixes")))


def layers(stem: Column, affixes: Column) -> Column:
    return F.when(F.size(affixes) > 0, F.concat(F.lit("Kök: "), stem, F.lit(" + Ekler: "), F.array_join(affixes, ", "))).otherwise("Yalın Kök")


def to_cyrillic(c: Column) -> Column:
    return F.replace(F.translate(c, S.CYRILLIC_FROM, S.CYRILLIC_TO), F.lit("c"), F.lit(S.CYRILLIC_C))


def _shifted(c: Column, pattern: str, to: str) -> Column:
    """The word with one correspondence applied, or null: at the start (^x), at the end (x$), or everywhere."""
    x = pattern.strip("^$")
    if pattern.startswith("^"):
        return F.when(F.startswith(c, F.lit(x)), F.concat(F.lit(to), F.substr(c, F.lit(len(x) + 1))))
    if pattern.endswith("$"):
        return F.when(F.endswith(c, F.lit(x)), F.concat(F.substr(c, F.lit(1), F.length(c) - len(x)), F.lit(to)))
    return F.when(F.contains(c, F.lit(x)), F.replace(c, F.lit(x), F.lit(to)))


def candidates(c: Column) -> Column:
    """The sorted set of forms that a word may have elsewhere: endings, sound shifts, Cyrillic, known roots."""
    none = F.array().cast("array<string>")
    ends = lambda n, forms: F.transform(strings(forms), lambda f: F.concat(F.substr(c, F.lit(1), F.length(c) - n), f))
    endings = F.when(F.right(c, F.lit(2)).isin("gi", "ge"), ends(2, S.GI_FORMS)).when(F.right(c, F.lit(3)).isin("lik", "lık"), ends(3, S.LIK_FORMS)).otherwise(none)
    shifted = F.array(*[_shifted(c, p, r) for p, r in S.SHIFTS])
    latin = F.array_distinct(F.concat(F.array(c), endings, F.filter(shifted, F.isnotnull)))
    roots = reduce(lambda acc, g: acc.when(holds(c, g[0]), strings(g[1])), S.ROOT_FORMS[1:], F.when(holds(c, S.ROOT_FORMS[0][0]), strings(S.ROOT_FORMS[0][1]))).otherwise(none)
    return F.array_sort(F.array_distinct(F.concat(latin, F.transform(latin, to_cyrillic), roots)))


def has_candidates(c: Column) -> Column:
    """Whether a word has a candidate besides itself; its Cyrillic form settles that for nearly every word."""
    return F.when(to_cyrillic(c) != c, True).otherwise(F.size(candidates(c)) > 1)


def variants(c: Column) -> Column:
    """The word first, then its other candidates; none for an empty word."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(c), F.array_remove(candidates(c), c)))


def matches(c: Column, pattern: str) -> Column:
    """``rlike``, without a regular expression where the pattern is a letter or some letters, anywhere or at an end."""
    simple = re.fullmatch(r"(\^?)(?:\[([\w]+)\]|(\w))(\$?)", pattern)
    if not simple or (simple[1] and simple[4]):
        return c.rlike(pattern)
    own = list(simple[2] or simple[3])
    return first_letter(c).isin(own) if simple[1] else F.right(c, F.lit(1)).isin(own) if simple[4] else holds(c, own)


def laws(source: Column, target: Column) -> Column:
    """Names of the sound laws that lead from source to target, in order."""
    return F.filter(F.array(*[F.when(matches(source, s) & matches(target, t), name) for name, s, t in S.LAWS]), F.isnotnull)


def laws_text(source: Column, target: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(laws(source, target), "; "), F.lit("")), F.lit(S.NO_LAW))


def letter_overlap(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch != "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def chain(source: Column, target: Column) -> Column:
    """struct(is_valid, score, rules, overlap, violations): whether laws or common letters link the two forms."""
    s, t = unstar(source), target
    s = F.when(s == "", t).otherwise(s)
    skeleton = lambda c: F.regexp_replace(F.translate(c, S.FOLD_FROM, S.FOLD_TO), "[^a-zçğıöşü]", "")
    found, overlap = laws(s, t), letter_overlap(skeleton(s), skeleton(t))
    ruled = F.size(found) > 0
    valid = ruled | (overlap >= 0.3)
    score = F.when(s == t, 1.0).when(ruled, 0.95).when(overlap >= 0.60, 0.85).when(overlap >= 0.30, 0.75).otherwise(0.20)
    rules = F.when(s == t, F.array(F.lit(S.SAME_SOUND))).when(ruled, found).otherwise(F.array(F.lit(S.SKELETON)))
    broken = F.when((s == t) | valid, F.array().cast("array<string>")).otherwise(F.array(filled(S.BROKEN_CHAIN, s, t)))
    return F.struct(((s == t) | valid).alias("is_valid"), score.alias("score"), rules.alias("rules"), overlap.alias("overlap"), broken.alias("violations"))


def sound_classes(c: Column) -> Column:
    known = F.translate(letters(c, S.ALPHABET_A), S.CLASS_FROM, S.CLASS_TO)
    return F.regexp_replace(known, "[^A-Z]", "X")


def hamming_table() -> dict[tuple[str, str], float]:
    """Share of differing features of each pair of known letters, to 3 places."""
    out = {}
    for a, x in S.ARTICULATION.items():
        for b, y in S.ARTICULATION.items():
            both = [p != q for p, q in zip(x, y, strict=True) if p and q]
            out[a, b] = math.floor(sum(both) / len(both) * 1000 + 0.5) / 1000
    return out


def neologism_proof(c: Column) -> Column:
    return filled(S.NEOLOGISM_PROOF, F.element_at(strings(S.NEOLOGISM_NOTES), neologism(c)))


def ipa(c: Column) -> Column:
    spelled = F.translate(c, S.IPA_FROM, S.IPA_TO)
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), S.IPA_PAIRS, spelled)


def ipa_report(c: Column) -> Column:
    """struct(ipa, vowel_harmony_status, vowel_count, initial_sound)."""
    harmony = F.when(disharmonic(c), S.OUT_OF_HARMONY).otherwise(S.IN_HARMONY)
    return F.struct(F.concat(F.lit("/"), ipa(c), F.lit("/")).alias("ipa"), harmony.alias("vowel_harmony_status"), F.length(vowels(c)).alias("vowel_count"), ipa(first_letter(c)).alias("initial_sound"))


def vowels(c: Column) -> Column:
    return F.regexp_replace(c, "[^aeıioöuü]", "")


def disharmonic(c: Column) -> Column:
    return c.rlike("[aıou]") & c.rlike("[eiöü]")


def donor_patterns(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), d) for p, d in S.DONOR_PATTERNS]), F.isnotnull)


def phonotactics(c: Column) -> Column:
    """How many of the two breaches (foreign initial, vowel harmony) a word has."""
    return first_letter(c).isin(S.FOREIGN_INITIALS).cast("int") + disharmonic(c).cast("int")


def phonotactic_report(c: Column) -> Column:
    """A sentence on the two breaches."""
    told = F.concat_ws("; ", F.when(first_letter(c).isin(S.FOREIGN_INITIALS), filled(S.PHONOTACTIC_INITIAL, first_letter(c))), F.when(disharmonic(c), F.lit(S.PHONOTACTIC_HARMONY)))
    return F.when(told != "", F.concat(F.lit(S.PHONOTACTIC_HEAD), told)).otherwise(S.PHONOTACTIC_CLEAN)


def suffix_report(c: Column) -> Column:
    """A sentence on stem and suffixes; null for an empty word, which has neither."""
    cut = strip_suffixes(c)
    bare = F.when(first_letter(c).isin(S.FOREIGN_INITIALS), filled(S.SUFFIX_FOREIGN, c)).otherwise(filled(S.SUFFIX_NONE, cut["stem"]))
    return F.when(c != "", F.when(F.size(cut["affixes"]) > 0, filled(S.SUFFIX_FOUND, cut["stem"], F.array_join(cut["affixes"], ", "))).otherwise(bare))


def fixed_reports(c: Column) -> Column:
    """struct(alignment, neighbours): sentences that say the same of every word."""
    return F.struct(filled(S.ALIGNED_TEXT, c).alias("alignment"), filled(S.NEIGHBOUR_TEXT, c).alias("neighbours"))


def classify(c: Column) -> Column:
    """struct(p_native, p_arabic_persian, p_greek_latin, p_western, classification, n_violations, violations); an empty word is native."""
    first = first_letter(c)
    points = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(0.0)
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    cluster = reduce(lambda a, b: a | b, [F.startswith(c, F.lit(x)) for x in S.CLUSTERS])
    native = F.greatest(10.0 - points(first.isin(S.RARE_INITIALS), 8.5) - points(cluster, 9) - points(disharmonic(c), 4.5), F.lit(0.5))
    sea = points(first.isin(list("fhpv")), 4)
    arabic = [c.rlike(p) for p, _ in S.ARABIC]
    persian = [F.endswith(c, F.lit(x)) for x in S.PERSIAN]
    western = [F.endswith(c, F.lit(x)) for x in S.WESTERN]
    east = sea + total([points(x, 6) for x in arabic]) + total([points(x, 5) for x in persian])
    west = points(first.isin(list("jzrl")), 5) + points(cluster, 6) + total([points(x, 6) for x in western])
    whole = native + east + sea + west
    p = {k: round_n(v / whole, 3) for k, v in (("native", native), ("east", east), ("greek", sea), ("west", west))}
    label = (
        F.when(p["native"] >= 0.65, S.CLASSES["native"])
        .when((p["greek"] > p["east"]) & (p["greek"] >= p["west"]), S.CLASSES["greek"])
        .when((p["greek"] == p["east"]) & first.isin(list("hkpf")), S.CLASSES["mediterranean"])
        .when(p["east"] >= F.greatest(p["greek"], p["west"]), S.CLASSES["east"])
        .when(p["greek"] >= p["west"], S.CLASSES["greek"])
        .otherwise(S.CLASSES["west"])
    )
    breaches = [first.isin(S.RARE_INITIALS), cluster, disharmonic(c), *arabic, *persian, *western]
    which = F.coalesce(*[F.when(F.startswith(c, F.lit(x)), F.lit(x)) for x in S.CLUSTERS])
    texts = [filled(S.BREACH_INITIAL, first), filled(S.BREACH_CLUSTER, which), F.lit(S.BREACH_HARMONY)]
    texts += [F.lit(form.format(x)) for form, names in ((S.BREACH_ARABIC, [n for _, n in S.ARABIC]), (S.BREACH_PERSIAN, S.PERSIAN), (S.BREACH_WESTERN, S.WESTERN)) for x in names]
    told = F.filter(F.array(*[F.when(b, t) for b, t in zip(breaches, texts, strict=True)]), F.isnotnull)
    return F.struct(p["native"].alias("p_native"), p["east"].alias("p_arabic_persian"), p["greek"].alias("p_greek_latin"), p["west"].alias("p_western"), label.alias("classification"), total([x.cast("int") for x in breaches]).alias("n_violations"), told.alias("violations"))


def neologism(c: Column) -> Column:
    """The first pattern (from 1) that marks a coined word, else null."""
    return F.when(F.length(c) >= 3, F.coalesce(*[F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(S.NEOLOGISMS, 1)]))


def neologism_report(c: Column) -> Column:
    """struct(is_neologism, derivation_type, etymology_details) of a coined word, else null."""
    return F.when(neologism(c).isNotNull(), F.struct(F.lit(True).alias("is_neologism"), F.lit(S.NEOLOGISM_TYPE).alias("derivation_type"), neologism_proof(c).alias("etymology_details")))


def proto_form(c: Column) -> Column:
    stem = strip_suffixes(c)["stem"]
    hard = F.when(F.startswith(stem, F.lit("h")), F.concat(F.lit("k"), F.substr(stem, F.lit(2)))).when(F.startswith(stem, F.lit("d")), F.concat(F.lit("t"), F.substr(stem, F.lit(2)))).otherwise(stem)
    l, r = F.instr(hard, "l"), F.instr(hard, "r")  # noqa: E741
    swapped = F.concat(F.substr(hard, F.lit(1), l - 1), F.lit("r"), F.substr(hard, l + 1, r - l - 1), F.lit("l"), F.substr(hard, r + 1))
    return F.concat(F.lit("*"), F.when(first_letter(c).isin(S.FOREIGN_INITIALS), c).when((l > 0) & (l < r), swapped).otherwise(hard))


def reconstruction(c: Column) -> Column:
    """struct(form, reconstructible, notes) of a word's ancestral form."""
    foreign, form = first_letter(c).isin(S.FOREIGN_INITIALS), proto_form(c)
    return F.struct(form.alias("form"), (~foreign).alias("reconstructible"), F.when(foreign, S.NOT_RECONSTRUCTED).otherwise(filled(S.RECONSTRUCTED, c, form)).alias("notes"))


def unattested_form(c: Column) -> Column:
    w = letters(normalise(c), S.ALPHABET_B)
    first = F.translate(first_letter(w), "ktm", "gdb")
    return F.when(w == "", F.lit("")).otherwise(F.concat(F.lit("*"), first, F.regexp_replace(F.substr(w, F.lit(2)), "[zs]$", "ŕ")))


def unattested_report(c: Column, entries: Column | None = None) -> Column:
    """struct(form, confidence, rules, notes): surer where more than one entry has a word of two letters or more; an empty word has no form."""
    w, form = letters(normalise(c), S.ALPHABET_B), unattested_form(c)
    others = F.size(F.filter(entries, lambda e: F.length(letters(e["word"], S.ALPHABET_B)) >= 2)) if entries is not None else F.lit(0)
    sure = F.when(w == "", 0.0).when(others > 1, 0.88).otherwise(0.75)
    rules = F.when(w == "", F.array().cast("array<string>")).otherwise(strings(S.UNATTESTED_RULES))
    return F.struct(form.alias("form"), sure.alias("confidence"), rules.alias("rules"), F.when(w == "", S.UNATTESTED_EMPTY).otherwise(filled(S.UNATTESTED_NOTES, w, form)).alias("notes"))


def induced_laws(source: Column, target: Column) -> Column:
    """Rule ids in the order initial, final, vowels; equal or empty words have none."""
    s, t = letters(source, S.ALPHABET_B), letters(target, S.ALPHABET_B)
    name = lambda kind, a, b: F.concat(F.lit(kind), F.upper(a), F.lit("_"), F.upper(b))
    rules = F.array(
        F.when(first_letter(s) != first_letter(t), name("INITIAL_", first_letter(s), first_letter(t))),
        F.when(F.right(s, F.lit(1)) != F.right(t, F.lit(1)), name("FINAL_", F.right(s, F.lit(1)), F.right(t, F.lit(1)))),
        F.when((vowels(s) != "") & (vowels(t) != "") & (vowels(s) != vowels(t)), "VOWEL_SHIFT"),
    )
    return F.when((s == "") | (t == "") | (s == t), F.array().cast("array<string>")).otherwise(F.filter(rules, F.isnotnull))


def induction(source: Column, target: Column) -> Column:
    """struct(rules, confidence) of :func:`induced_laws`: equal or empty words are sure, words without a rule doubtful."""
    s, t, rules = letters(source, S.ALPHABET_B), letters(target, S.ALPHABET_B), induced_laws(source, target)
    sure = F.when((s == "") | (t == "") | (s == t), 1.0).when(F.size(rules) > 0, 0.95).otherwise(0.70)
    return F.struct(rules.alias("rules"), sure.alias("confidence"))


def law_structs(source: Column, target: Column) -> Column:
    """Array of struct(rule_id, pattern, position, description) of the rules of :func:`induced_laws`."""
    s, t = letters(source, S.ALPHABET_B), letters(target, S.ALPHABET_B)
    right = lambda c: F.right(c, F.lit(1))

    def law(rule: Column) -> Column:
        initial, final = F.startswith(rule, F.lit("INITIAL_")), F.startswith(rule, F.lit("FINAL_"))
        pick = lambda a, b, c: F.when(initial, a).when(final, b).otherwise(c)
        pattern = pick(filled("#{} -> #{}", first_letter(s), first_letter(t)), filled("{}# -> {}#", right(s), right(t)), filled("{} -> {}", vowels(s), vowels(t)))
        told = pick(filled(S.LAW_INITIAL, first_letter(s), first_letter(t)), filled(S.LAW_FINAL, right(s), right(t)), filled(S.LAW_VOWELS, vowels(s), vowels(t)))
        return F.struct(rule.alias("rule_id"), pattern.alias("pattern"), pick(F.lit("initial"), F.lit("final"), F.lit("medial")).alias("position"), told.alias("description"))

    return F.transform(induced_laws(source, target), law)


def evidence(entries: Column) -> Column:
    """Lines ``language (word): meaning`` of the first six entries, of those with a meaning that isn't a placeholder."""
    told = F.filter(F.slice(entries, 1, 6), lambda e: (F.coalesce(e["meaning"], F.lit("")) != "") & ~F.startswith(e["meaning"], F.lit("Online")))
    return F.transform(told, lambda e: filled("{} ({}): {}", e["lang_name"], e["word"], e["meaning"]))


def references(c: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit("(?iu)" + p), F.lit(1)) for p in S.REFERENCES]))
    return F.filter(F.array_distinct(F.transform(found, F.lower)), lambda x: F.length(x) >= 2)


def region(c: Column) -> Column:
    """struct(location, region, lat, lon) of the first place that the text names."""
    made = lambda loc, reg, lat, lon: F.struct(loc.alias("location"), F.lit(reg).alias("region"), F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"))
    hits = [F.when(F.contains(F.lower(c), F.lit(p.lower())), made(F.lit(p), reg, lat, lon)) for p, reg, lat, lon in S.PLACES]
    return F.coalesce(*hits, made(F.trim(c), S.NO_REGION, None, None))


def year(c: Column) -> Column:
    """A year, a century's middle, or a named period's year; before the era negative. Null where there is none."""
    low = F.lower(c)
    sign = F.when(low.rlike(r"m\.ö|mö|bc"), -1).otherwise(1)
    digits = F.nullif(F.regexp_extract(c, r"(?:^|[^\p{L}\p{N}_])(1\d{3}|20\d{2}|\d{3})(?:[^\p{L}\p{N}_]|$)", 1), F.lit("")).cast("int")
    century = F.nullif(F.regexp_extract(low, r"(\d{1,2})\.?\s*(?:yy|yüzyıl|century)", 1), F.lit("")).cast("int")
    named = F.coalesce(*[F.when(low.rlike("|".join(words)), F.lit(y)) for words, y in S.PERIODS])
    return F.coalesce(digits * sign, ((century - 1) * 100 + 50) * sign, named)


def time_lock(source: Column, target: Column) -> Column:
    """Whether the source is no later than the target; true where either year is unknown."""
    return F.coalesce(year(source) <= year(target), F.lit(True))


def ngrams(c: Column) -> Column:
    """Each token, and all its 2- to 4-grams, repeats kept."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+"), lambda t: t != "")
    # n-grams of a token: a window of each width at every place where it fits
    grams = lambda t, n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), grams(t, 2), grams(t, 3), grams(t, 4))))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return round_n(1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)), 4)


def spread(languages: Column) -> Column:
    """struct(ratio, score, assessment) of a number of languages out of 25."""
    ratio = round_n(languages / 25.0, 2)
    label = F.when(languages == 0, S.NO_DATA).when(ratio >= S.SPREADS[0][0], S.SPREADS[0][1]).when(ratio >= S.SPREADS[1][0], S.SPREADS[1][1]).otherwise(S.SPREADS[2][1])
    score = F.when(languages == 0, 0.0).otherwise(round_n(85.0 + F.least(ratio * 15.0, F.lit(15.0)), 1))
    return F.struct(F.least(ratio, F.lit(1.0)).alias("ratio"), score.alias("score"), label.alias("assessment"))


def plain_text(c: Column) -> Column:
    """A page's text without tags, white space run together."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))


def html_text(c: Column, length: int = 2500) -> Column:
    """Up to ``length`` signs of a page: of its first ten blocks those of 30 signs or more that aren't page furniture, or the whole page where it has no blocks."""
    bare = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    blocks = F.regexp_extract_all(bare, F.lit(r'(?is)<(?:p|article|blockquote|div[^>]*class="[^"]*content[^"]*")[^>]*>(.*?)</(?:p|article|blockquote|div)>'), F.lit(1))
    texts = F.transform(F.slice(blocks, 1, 10), lambda x: strip(F.regexp_replace(x, r"(?s)<[^>]+>", " ")))
    told = F.filter(texts, lambda x: (F.length(x) >= 30) & ~holds(F.lower(x), S.FURNITURE))
    return F.substring(F.when(F.size(blocks) > 0, plain_text(F.array_join(told, " "))).otherwise(plain_text(bare)), 1, length)
