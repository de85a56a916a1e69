"""Stems of a list of terms in DuckDB SQL."""

from __future__ import annotations

from ..functions import stems as S


def _cut(n: int, x: str = "w") -> str:
    return f"{x}[:-{n + 1}]"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _table(values: dict[str, str]) -> str:
    stem, suffix = (f"regexp_extract(w, '{S.ending(values)}', {i})" for i in (1, 2))
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items())
    return f"CASE WHEN {_has(stem, S.MEASURE_1)} THEN {stem} || CASE {suffix} {cases} END ELSE w END"


_OPEN = "regexp_extract(w, '^(.*?)(?:ed|ing)$', 1)"
_LAST = f"regexp_extract(w, '{S.ending(S.STEP_4)}', 1)"
STEPS = [
    f"CASE WHEN {_has('w', S.STEMMABLE)} THEN w ELSE w || chr(2) END",
    f"CASE WHEN {_has('w', '(?:ss|i)es$')} THEN {_cut(2)} WHEN {_has('w', '(?:^|[^s])s$')} THEN {_cut(1)} ELSE w END",
    f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_has(_cut(3), S.MEASURE_1)} THEN {_cut(1)} ELSE w END
 WHEN {_has(_OPEN, S.VOWEL)} THEN {_OPEN} || chr(1) ELSE w END""",
    f"""CASE WHEN NOT ends_with(w, chr(1)) THEN w WHEN {_has(_cut(1), '(?:at|bl|iz)$')} THEN {_cut(1)} || 'e'
 WHEN {_has(_cut(1), S.DOUBLE)} THEN {_cut(2)} WHEN {_has(_cut(1), S.SHORT)} THEN {_cut(1)} || 'e' ELSE {_cut(1)} END""",
    f"CASE WHEN ends_with(w, 'y') AND {_has(_cut(1), S.VOWEL)} THEN {_cut(1)} || 'i' ELSE w END",
    _table(S.STEP_2),
    _table(S.STEP_3),
    f"""CASE WHEN {_has(_LAST, S.MEASURE_2)} AND (regexp_extract(w, '{S.ending(S.STEP_4)}', 2) <> 'ion' OR {_has(_LAST, '[st]$')})
 THEN {_LAST} ELSE w END""",
    f"""CASE WHEN ends_with(w, 'e') AND ({_has(_cut(1), S.MEASURE_2)} OR ({_has(_cut(1), S.MEASURE_ONE)} AND NOT {_has(_cut(1), S.SHORT)}))
 THEN {_cut(1)} ELSE w END""",
    f"CASE WHEN ends_with(w, 'll') AND {_has('w', S.MEASURE_2)} THEN {_cut(1)} ELSE w END",
    f"CASE WHEN ends_with(w, chr(2)) THEN {_cut(1)} ELSE w END",
]


def stems(words: str) -> str:
    for step in STEPS:
        words = f"list_transform({words}, lambda w: {step})"
    return words
