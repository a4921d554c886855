"""Boolean trigram queries that every match of a regular expression implies."""

import re
from re import _constants as codes
from re import _parser as parser

#: A query is True (no constraint), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple[str, frozenset]

MOST_STRINGS = 64
MOST_CLASS = 4


def combined(kind: str, queries) -> Query:
    parts = set()
    for query in queries:
        if query is True:
            if kind == "or":
                return True
        elif isinstance(query, tuple) and query[0] == kind:
            parts |= query[1]
        else:
            parts.add(query)
    if not parts:
        return True
    if kind == "or":  # a part that asks for more than another adds nothing
        asked = {part: part[1] if isinstance(part, tuple) else frozenset([part]) for part in parts}
        parts = {a for a in parts if not any(asked[b] < asked[a] for b in parts)}
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def of_strings(strings: set[str]) -> Query:
    """One of the strings occurs."""

    def of_string(text: str) -> Query:
        return combined("and", [text[i : i + 3] for i in range(len(text) - 2)])

    return combined("or", [of_string(text) for text in strings])


def of_sequence(items) -> tuple[set[str] | None, Query]:
    """(all strings that match, if they are few; the query otherwise)."""
    strings, query, exact = {""}, True, True
    for code, argument in items:
        found, needed = of_item(code, argument)
        if found is not None and len(strings) * len(found) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in found}
            continue
        here = of_strings(found) if found is not None else needed
        query = combined("and", [query, of_strings(strings), here])
        strings, exact = {""}, False
    if exact:
        return strings, True
    return None, combined("and", [query, of_strings(strings)])


def of_item(code, argument) -> tuple[set[str] | None, Query]:
    if code is codes.LITERAL:
        return {chr(argument).lower()}, True
    if code is codes.AT:
        return {""}, True
    if code is codes.SUBPATTERN:
        return of_sequence(argument[3])
    if code is codes.BRANCH:
        found = [of_sequence(branch) for branch in argument[1]]
        if all(strings is not None for strings, _ in found):
            together = set().union(*[strings for strings, _ in found])
            if len(together) <= MOST_STRINGS:
                return together, True
        return None, combined(
            "or", [of_strings(s) if s is not None else q for s, q in found]
        )
    if code is codes.IN:
        letters = {chr(a).lower() for c, a in argument if c is codes.LITERAL}
        if len(argument) <= MOST_CLASS and all(c is codes.LITERAL for c, _ in argument):
            return letters, True
        return None, True
    if code in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
        least, most, inner = argument
        found, needed = of_sequence(inner)
        if found is not None and most == 1:
            return found | ({""} if least == 0 else set()), True
        if least == 0:
            return None, True
        return None, of_strings(found) if found is not None else needed
    return None, True


def trigram_query(pattern: str) -> Query:
    """For texts in lower case: a text without what the query asks for has no match."""
    strings, query = of_sequence(parser.parse(pattern, re.IGNORECASE))
    return of_strings(strings) if strings is not None else query


def trigrams_in(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    if isinstance(query, tuple):
        return set().union(*[trigrams_in(part) for part in query[1]])
    return set()
