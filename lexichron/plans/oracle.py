"""SQL of the operators that take several steps: alignment, meaning distance, sound chains, the referee.

Each function returns common table expressions to be put behind WITH; nothing here runs in Spark."""

from __future__ import annotations

from ..functions import seeds as S


def q(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def rx(c: str, p: str) -> str:
    return f"regexp_matches({c}, {q(p)})"


def picked(cases) -> str:
    """SQL list of the labels whose conditions hold, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(v)} END" for c, v in cases) + "], lambda x: x IS NOT NULL)"


def laws(a: str, b: str) -> str:
    return picked((f"{rx(a, s)} AND {rx(b, t)}", name) for name, s, t in S.LAWS)


def skeleton(c: str) -> str:
    return f"list_filter(list_distinct(string_split(regexp_replace(translate({c}, '{S.FOLD_FROM}', '{S.FOLD_TO}'), '[^a-zçğıöşü]', '', 'g'), '')), lambda x: x <> '')"


def overlap(a: str, b: str) -> str:
    return f"CAST(len(list_intersect({skeleton(a)}, {skeleton(b)})) AS DOUBLE) / greatest(len({skeleton(a)}), len({skeleton(b)}), 1)"


def letters(c: str, alphabet: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '^\\*+', ''), '[^{alphabet}]', '', 'g')"


def rounded(c: str, n: int) -> str:
    return f"floor(({c}) * {10**n} + 0.5::DOUBLE) / {float(10**n)}::DOUBLE"


def candidate_list(w: str) -> str:
    ends = lambda n, forms: f"list_transform({listed(forms)}, lambda f: left({w}, length({w}) - {n}) || f)"
    none = "[]::VARCHAR[]"
    shifts = ", ".join(f"CASE WHEN {rx(w, p)} THEN regexp_replace({w}, {q(p)}, {q(r)}, 'g') END" for p, r in S.SHIFTS)
    latin = f"list_distinct(list_concat([{w}], CASE WHEN {rx(w, '(gi|ge)$')} THEN {ends(2, S.GI_FORMS)} WHEN {rx(w, '(lik|lık)$')} THEN {ends(3, S.LIK_FORMS)} ELSE {none} END, list_filter([{shifts}], lambda x: x IS NOT NULL)))"
    roots = "CASE " + " ".join(f"WHEN {rx(w, '|'.join(k))} THEN {listed(v)}" for k, v in S.ROOT_FORMS) + f" ELSE {none} END"
    cyrillic = f"replace(translate(f, '{S.CYRILLIC_FROM}', '{S.CYRILLIC_TO}'), 'c', '{S.CYRILLIC_C}')"
    return f"list_sort(list_distinct(list_concat({latin}, list_transform({latin}, lambda f: {cyrillic}), {roots})))"


def translated(c: str) -> str:
    """A meaning by the first key that it holds, else bare of templates and brackets."""
    bare = rf"trim(regexp_replace(trim(regexp_replace(trim({c}), '\{{\{{.*?\}}\}}', '', 'g')), '\[\[(.*?)\]\]', '\1', 'g'))"
    known = " ".join(f"WHEN contains(lower({bare}), {q(k)}) THEN {q(v)}" for k, v in S.MEANINGS)
    return f"CASE WHEN trim({c}) = '' OR starts_with(trim({c}), 'Online') THEN trim({c}) {known} WHEN {bare} <> '' THEN {bare} ELSE {c} END"


def year(c: str) -> str:
    sign = rf"(CASE WHEN regexp_matches(lower({c}), 'm\.ö|mö|bc') THEN -1 ELSE 1 END)"
    named = " ".join(f"WHEN regexp_matches(lower({c}), '{'|'.join(k)}') THEN {y}" for k, y in S.PERIODS)
    return rf"""coalesce(CAST(nullif(regexp_extract({c}, '(?:^|[^\p{{L}}\p{{N}}_])(1\d{{3}}|20\d{{2}}|\d{{3}})(?:[^\p{{L}}\p{{N}}_]|$)', 1), '') AS INT) * {sign},
 ((CAST(nullif(regexp_extract(lower({c}), '(\d{{1,2}})\.?\s*(?:yy|yüzyıl|century)', 1), '') AS INT) - 1) * 100 + 50) * {sign}, CASE {named} END)"""


def align(pairs: str) -> str:
    """``al`` (x, y, raw, similarity, distance, aligned_a, aligned_b) of the distinct (x, y) in the table ``pairs``: two folds, over
    the letters of x and within them over the letters of y, of cells with the score, both words so far and the edit distance."""
    names = "".join(S.ARTICULATION)
    features = ", ".join(f"({i}, {listed(v)})" for i, v in enumerate(S.ARTICULATION.values()))
    kind = lambda c: f"regexp_replace(translate({c}, '{S.CLASS_FROM}', '{S.CLASS_TO}'), '[^A-Z]', 'X', 'g')"
    cost = f"CASE WHEN instr('{names}', cx) > 0 AND instr('{names}', cy) > 0 THEN hl[(instr('{names}', cx) - 1) * {len(names)} + instr('{names}', cy)] ELSE 0.5::DOUBLE END"
    # a cell's letters and costs are taken from lists made before the folds: step i * length(y) + j
    cell = """list_append(cur, {'s': greatest(prev[j].s + mt[(i - 1) * n + j], prev[j + 1].s - 2, cur[j].s - 2),
 'u': CASE WHEN prev[j].s + mt[(i - 1) * n + j] >= greatest(prev[j + 1].s - 2, cur[j].s - 2) THEN prev[j].u || x[i] WHEN prev[j + 1].s >= cur[j].s THEN prev[j + 1].u || x[i] ELSE cur[j].u || '-' END,
 'v': CASE WHEN prev[j].s + mt[(i - 1) * n + j] >= greatest(prev[j + 1].s - 2, cur[j].s - 2) THEN prev[j].v || y[j] WHEN prev[j + 1].s >= cur[j].s THEN prev[j + 1].v || '-' ELSE cur[j].v || y[j] END,
 'e': least(prev[j + 1].e + 1, cur[j].e + 1, prev[j].e + ct[(i - 1) * n + j])})"""
    return f"""art(p, v) AS (VALUES {features}),
hd AS (SELECT a.p AS p, b.p AS q, floor(len(list_filter(list_zip(a.v, b.v), lambda z: z[1] <> 0 AND z[2] <> 0 AND z[1] <> z[2])) / CAST(len(list_filter(list_zip(a.v, b.v), lambda z: z[1] <> 0 AND z[2] <> 0)) AS DOUBLE) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS d FROM art a, art b),
hs AS (SELECT list(d ORDER BY p, q) AS hl FROM hd),
ap AS (SELECT DISTINCT x, y FROM {pairs} WHERE x <> '' AND y <> ''),
ac AS (SELECT x, y, length(x) AS m, length(y) AS n, {kind('x')} AS kx, {kind('y')} AS ky, hl FROM ap, hs),
ad AS (SELECT *, flatten(list_transform(range(1, m + 1), lambda i: list_transform(range(1, n + 1), lambda j: {cost.replace('cx', 'x[i]').replace('cy', 'y[j]')}))) AS ct FROM ac),
am AS (SELECT x, y, m, n, ct, list_transform(range(1, m * n + 1), lambda k: CASE WHEN x[(k - 1) // n + 1] = y[(k - 1) % n + 1] THEN 3 WHEN kx[(k - 1) // n + 1] = ky[(k - 1) % n + 1] THEN 2 WHEN ct[k] <= 0.35 THEN 1 ELSE -1 END) AS mt FROM ad),
af AS (SELECT x, y, greatest(m, n) AS longest, list_reduce(range(1, m + 1), lambda prev, i: list_reduce(range(1, n + 1), lambda cur, j: {cell},
  [{{'s': (-2 * i)::INT, 'u': left(x, i), 'v': repeat('-', i), 'e': i::DOUBLE}}]),
  list_transform(range(0, n + 1), lambda j: {{'s': (-2 * j)::INT, 'u': repeat('-', j), 'v': left(y, j), 'e': j::DOUBLE}}))[-1] AS c FROM am),
ag AS (SELECT x, y, c.s AS raw, c.u AS aligned_a, c.v AS aligned_b, floor(c.e / longest * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS distance, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(c.s AS DOUBLE) / (3 * longest))) AS shape FROM af),
al AS (SELECT x, y, raw, floor((shape * 0.5 + floor(greatest(0.0::DOUBLE, 1 - distance) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE * 0.5) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS similarity, distance, aligned_a, aligned_b FROM ag
 UNION ALL SELECT DISTINCT x, y, 0, 0.0::DOUBLE, 1.0::DOUBLE, x, y FROM {pairs} WHERE x = '' OR y = '')"""


def edits(a: str, b: str) -> str:
    """Levenshtein's distance by letters (DuckDB's own goes by bytes)."""
    cell = f"list_append(cur, least(prev[j + 1] + 1, cur[j] + 1, prev[j] + CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END))"
    return f"list_reduce(range(1, length({a}) + 1), lambda prev, i: list_reduce(range(1, length({b}) + 1), lambda cur, j: {cell}, [i]), range(0, length({b}) + 1))[-1]"


def drift(pairs: str) -> str:
    """``dd`` (old, new, distance) of the distinct texts in the table ``pairs`` (old, new), none of them blank: hashed n-gram vectors in ten-thousandths."""
    return rf"""dp AS (SELECT DISTINCT old, new FROM {pairs} WHERE trim(old) <> '' AND trim(new) <> ''),
dt AS (SELECT old AS x FROM dp UNION SELECT new FROM dp),
dw AS (SELECT x, unnest(string_split_regex(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+')) AS w FROM dt),
dg AS (SELECT x, gram, count(*) AS f FROM (SELECT x, unnest(list_concat([w], list_concat(list_transform(range(1, length(w)), lambda i: substring(w, i, 2)),
  list_concat(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4)))))) AS gram FROM dw WHERE w <> '') GROUP BY x, gram),
dv AS (SELECT x, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS dim, sum(1 + ln(f)) AS v FROM dg GROUP BY 1, 2),
dn AS (SELECT x, sqrt(sum(v * v)) AS norm FROM dv GROUP BY x),
di AS (SELECT x, dim, CAST(floor(v / norm * 10000 + 0.5::DOUBLE) AS BIGINT) AS v FROM dv JOIN dn USING (x)),
dl AS (SELECT x, list_transform(range(0, 64), lambda d: CAST(coalesce(vs[list_position(ds, d)], 0) AS DOUBLE)) AS v FROM (SELECT x, list(v ORDER BY dim) AS vs, list(dim ORDER BY dim) AS ds FROM di GROUP BY x)),
do_ AS (SELECT old, new, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS dot FROM dp JOIN dl a ON a.x = old JOIN dl b ON b.x = new),
dd AS (SELECT old, new, CAST((100000000 - greatest(0, least(100000000, coalesce(dot, 0))) + 5000) // 10000 AS DOUBLE) / 10000.0::DOUBLE AS distance FROM dp LEFT JOIN do_ USING (old, new))"""


def referee(h: str) -> str:
    """``verdict`` (id, ..., status, confidence, and the report's columns) of the rows of the table ``h`` (id, word, origin, donor, proof, meaning, attestation)."""
    source = "coalesce(donor, '') || ' ' || coalesce(proof, '')"
    badge = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.BADGES.items())
    broken = [q(x) for x in S.BROKEN_CHAIN.split("{}")]
    late = [q(x) for x in S.ANACHRONISM.split("{}")]
    bad = [q(x) for x in S.BAD_SENSE.split("{}")]
    return rf"""h0 AS (SELECT *, CASE WHEN o = '' THEN word ELSE o END AS frm FROM (SELECT *, regexp_replace(trim(coalesce(origin, '')), '^\*+', '') AS o FROM {h})),
h1 AS (SELECT *, {letters('frm', S.ALPHABET_A)} AS x, {letters('word', S.ALPHABET_A)} AS y, CASE WHEN s0 = '' THEN t ELSE s0 END AS s FROM (SELECT *, regexp_replace(lower(trim(frm)), '^\*+', '') AS s0, lower(trim(word)) AS t FROM h0)),
{align('h1')},
hm AS (SELECT lower(meaning) AS old, lower(proof) AS new FROM {h} WHERE meaning <> '' AND proof <> ''),
{drift('hm')},
h2 AS (SELECT *, {laws('s', 't')} AS found, {overlap('s', 't')} AS o2 FROM h1),
h3 AS (SELECT *, s = t OR len(found) > 0 OR o2 >= 0.3 AS chain_valid, CASE WHEN s = t THEN 1.0 WHEN len(found) > 0 THEN 0.95 WHEN o2 >= 0.6 THEN 0.85 WHEN o2 >= 0.3 THEN 0.75 ELSE 0.2 END::DOUBLE AS chain_score,
 CASE WHEN s = t THEN {listed([S.SAME_SOUND])} WHEN len(found) > 0 THEN found ELSE {listed([S.SKELETON])} END AS rules FROM h2),
h4 AS (SELECT h3.*, al.raw, al.similarity, al.distance AS sound_distance, al.aligned_a, al.aligned_b, {rounded('chain_score * 0.6 + al.similarity * 0.4', 3)} AS sound, chain_valid AND (al.similarity > 0.15 OR frm = word) AS sound_valid,
 coalesce({year(source)} <= {year('attestation')}, true) AS time_valid, {year(source)} AS y1, {year('attestation')} AS y2, {source} AS src,
 coalesce(meaning, '') <> '' AND coalesce(proof, '') <> '' AS known, coalesce(dd.distance, 0.0::DOUBLE) AS distance,
 {candidate_list('t')} AS forms FROM h3 JOIN al ON al.x = h3.x AND al.y = h3.y LEFT JOIN dd ON dd.old = lower(meaning) AND dd.new = lower(proof)),
h5 AS (SELECT *, CASE WHEN known THEN greatest(0.20::DOUBLE, {rounded('1.0::DOUBLE - distance', 3)}) ELSE 0.85::DOUBLE END AS sense, CASE WHEN len(forms) > 1 THEN 0.95::DOUBLE ELSE 0.60::DOUBLE END AS cognate, {rounded('distance * 1.10::DOUBLE', 3)} AS speed FROM h4),
h6 AS (SELECT *, sound * 0.35::DOUBLE + time_valid::INT::DOUBLE * 0.30::DOUBLE + sense * 0.15::DOUBLE + cognate * 0.20::DOUBLE AS s1 FROM h5),
h7 AS (SELECT *, CASE WHEN sound_valid THEN s1 ELSE s1 * 0.4::DOUBLE END AS s2 FROM h6),
h8 AS (SELECT *, CASE WHEN time_valid THEN s2 ELSE least(s2, 0.30::DOUBLE) END AS total FROM h7),
h9 AS (SELECT *, CASE WHEN chain_valid AND time_valid AND total >= 0.75 THEN 'VALIDATED' WHEN chain_valid AND time_valid AND total >= 0.50 THEN 'NEEDS_REVIEW' ELSE 'REJECTED' END AS status, {rounded('total', 3)} AS confidence,
 CASE WHEN chain_valid THEN []::VARCHAR[] ELSE [{broken[0]} || s || {broken[1]} || t || {broken[2]}] END AS violations,
 CASE WHEN NOT time_valid THEN {late[0]} || src || {late[1]} || y1 || {late[2]} || attestation || {late[3]} || y2 || {late[4]} END AS time_violation,
 CASE WHEN NOT known THEN {q(S.NO_SENSE)} WHEN speed <= 0.85 THEN {q(S.GOOD_SENSE)} ELSE {bad[0]} || CAST(speed AS VARCHAR) || {bad[1]} END AS sense_reason FROM h8),
verdict AS (SELECT *, CASE status {badge} END AS badge, '%' || CAST({rounded('total * 100', 1)} AS VARCHAR) AS score_percentage,
 list_concat(CASE WHEN sound_valid THEN []::VARCHAR[] ELSE violations END, CASE WHEN time_violation IS NULL THEN []::VARCHAR[] ELSE [time_violation] END) AS rejection_reasons FROM h9)"""
