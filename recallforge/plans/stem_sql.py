"""The stemmer as SQL, a column a step, for the queries' DuckDB counterparts; it shares the fixed tables only."""

from __future__ import annotations

from recallforge.functions import stem as S

VOWEL, REST = "[aeiouy]", "[^aeiouy]"
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cases(table: dict[str, str], of: str) -> str:
    return " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in table.items())


def _suffix(of: str, suffixes) -> str:
    """The longest of the suffixes that the word ends with: the leftmost match is the longest."""
    return f"regexp_extract({of}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$')"


def _cut(of: str, n: str) -> str:
    return f"left({of}, greatest(length({of}) - {n}, 0))"


def _region(of: str) -> str:
    return f"CASE WHEN regexp_matches({of}, '{VOWEL}{REST}') THEN length(regexp_extract({of}, '^.*?{VOWEL}{REST}')) ELSE length({of}) END"


def stems(words: str) -> str:
    """CTEs that end in ``st(word, stem)``, of the distinct words that the select ``words`` gives as ``word``."""
    steps = [
        f"SELECT word, regexp_replace(word, '^''', '') AS w FROM ({words}) AS given",
        "SELECT word, w AS raw, regexp_replace(regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g'), '([aeiouyY])y', '\\1Y', 'g') AS w FROM {0}",
        f"SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) ELSE {_region('w')} END AS r1 FROM {{0}}",
        f"SELECT *, r1 + {_region('substr(w, r1 + 1)')} AS r2 FROM {{0}}",
        "SELECT * REPLACE (regexp_replace(w, '(''s''|''s|'')$', '') AS w) FROM {0}",
        f"SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN {_cut('w', '2')} WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut('w', '2')} ELSE {_cut('w', '1')} END WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') AND regexp_matches({_cut('w', '2')}, '{VOWEL}') THEN {_cut('w', '1')} ELSE w END AS w) FROM {{0}}",
        f"SELECT *, w AS early, {_suffix('w', ('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'))} AS s FROM {{0}}",
        f"SELECT *, {_cut('w', 'length(s)')} AS b FROM {{0}}",
        f"SELECT * EXCLUDE (s, b) REPLACE (CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN s <> '' AND regexp_matches(b, '{VOWEL}') THEN CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {_cut('b', '1')} WHEN r1 >= length(b) AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END ELSE w END AS w) FROM {{0}}",
        f"SELECT * REPLACE (CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {_cut('w', '1')} || 'i' ELSE w END AS w) FROM {{0}}",
        f"SELECT *, {_suffix('w', (*S.STEP2, 'ogi', 'li'))} AS s FROM {{0}}",
        f"SELECT * EXCLUDE (s) REPLACE (CASE WHEN s = '' OR length(w) - length(s) < r1 THEN w WHEN s = 'ogi' THEN CASE WHEN regexp_matches(w, 'logi$') THEN {_cut('w', '1')} ELSE w END WHEN s = 'li' THEN CASE WHEN regexp_matches(w, '[cdeghkmnrt]li$') THEN {_cut('w', '2')} ELSE w END ELSE {_cut('w', 'length(s)')} || CASE s {_cases(S.STEP2, 's')} ELSE '' END END AS w) FROM {{0}}",
        f"SELECT *, {_suffix('w', (*S.STEP3, 'ative'))} AS s FROM {{0}}",
        f"SELECT * EXCLUDE (s) REPLACE (CASE WHEN s <> '' AND length(w) - length(s) >= CASE s WHEN 'ative' THEN r2 ELSE r1 END THEN {_cut('w', 'length(s)')} || CASE s {_cases(S.STEP3, 's')} ELSE '' END ELSE w END AS w) FROM {{0}}",
        f"SELECT *, {_suffix('w', (*S.STEP4, 'ion'))} AS s FROM {{0}}",
        f"SELECT * EXCLUDE (s) REPLACE (CASE WHEN s <> '' AND length(w) - length(s) >= r2 AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {_cut('w', 'length(s)')} ELSE w END AS w) FROM {{0}}",
        f"SELECT * REPLACE (CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches({_cut('w', '1')}, '{_SHORT}'))) THEN {_cut('w', '1')} WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {_cut('w', '1')} ELSE w END AS w) FROM {{0}}",
    ]
    ctes, last = [], ""
    for k, step in enumerate(steps):
        ctes.append(f"st{k} AS MATERIALIZED ({step.format(last) if k else step})" if k == 0 else f"st{k} AS ({step.replace('{0}', last)})")
        last = f"st{k}"
    kept = ", ".join(_text(w) for w in sorted(S.INVARIANT))
    ctes.append(f"st AS MATERIALIZED (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN raw IN ({', '.join(map(_text, S.EXCEPTIONS))}) THEN CASE raw {_cases(S.EXCEPTIONS, 'raw')} END WHEN length(raw) <= 2 THEN raw WHEN early IN ({kept}) THEN early ELSE lower(w) END AS stem FROM {last})")
    return ", ".join(ctes)
