"""SQL fragments for DuckDB of the engine's scalar functions."""

from __future__ import annotations

from tessera.functions import vocabulary as v


def _list(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_list(sorted(set(v.STOPWORDS)))}, t))"


def content_tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: length(t) > 2))"


def normalise(text: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({text}, '')), '—–-/', '    '), '\\s+', ' ', 'g'))"


def sentences(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(coalesce({text}, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '')"


def any_of(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def topics(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    quantity = v.QUANTITY_QUESTION.replace("'", "''")
    worked = f"({any_of(low, v.WORK_VERBS)} AND {any_of(low, v.DESIGNATIONS)} AND NOT regexp_matches({low}, '{quantity}'))"
    cases = ", ".join(f"CASE WHEN {any_of(low, keys)}{' OR ' + worked if t == 'refrigerant' else ''} THEN '{t}' END" for t, keys in v.SAFETY_TOPICS.items())
    return f"list_sort(list_filter([{cases}], lambda t: t IS NOT NULL))"


def idf(n: str, df: str) -> str:
    return f"ln(({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE) + 1)"


def weight(tf: str, dl: str, avgdl: str) -> str:
    return f"{tf} * {v.K1 + 1}::DOUBLE / ({tf} + {v.K1}::DOUBLE * (1 - {v.B}::DOUBLE + {v.B}::DOUBLE * {dl} / {avgdl}))"


def phrase(key: str) -> str:
    """A question's beginning, dealt by a key."""
    return "CASE " + f"{key} % {len(PHRASES)}" + " " + " ".join(f"WHEN {i} THEN '{p.replace(chr(39), chr(39) * 2)}'" for i, p in enumerate(PHRASES)) + " END"


#: Beginnings that give plain prose the features that questions have.
PHRASES = [
    "How do I recover the R32 charge? ",
    "The unit won't start and shows E 04. ",
    "What size is the conductor? ",
    "How much R32 charge does it carry? ",
    "Heat pump keeps icing up, code E12. ",
    "Is it safe to open the panel on a live circuit? ",
    "Where do I order the part number? ",
    "Error E-07 on the T-100 chiller. ",
    "Steps to clean the coil and flush the drain? ",
    "Rated capacity of the unit? ",
    "Can I solder near the relief valve? ",
    "Hello. ",
]
