"""Vocabulary of the query language."""

# Fixed values of the language.
CLAUSES = ("from", "fields", "join", "inner", "left", "as", "on", "unnest", "let", "where", "aggregate", "collect", "having", "select", "order", "limit", "distinct")
GROUPING = ("by", "rollup", "asc", "desc")
LOGIC = ("and", "or", "not", "in", "exists", "is")
PATTERNS = ("matches", "starts_with", "ends_with", "contains")
REDUCERS = ("sum", "count", "avg", "min", "max")
LITERALS = ("true", "false", "null")
TYPES = ("string", "number", "bool", "null", "array", "object")
#: Scalar functions: least and most arguments.
FUNCTIONS = {
    "round": (1, 2), "if": (3, 3), "length": (1, 1), "lower": (1, 1), "upper": (1, 1), "abs": (1, 1), "floor": (1, 1), "ceil": (1, 1), "sqrt": (1, 1),
    "pow": (2, 2), "mod": (2, 2), "trim": (1, 1), "substr": (3, 3), "replace": (3, 3),
}
COMPARISONS = ("==", "!=", "<=", ">=", "<", ">")
ARITHMETIC = ("+", "-", "*", "/")
PUNCTUATION = ("...", "??", ".**", "[]", *COMPARISONS, "=", *ARITHMETIC, ".", ",", ":", "(", ")", "[", "]", "{", "}", "$")

#: What an editor offers after a word; after all others an operator or the next clause.
FOLLOWED_BY = {
    "from": "source", "join": "source", "as": "new name", "fields": "new name", "let": "new name", "is": "type", "limit": "number", "inner": "join", "left": "join", "order": "by",
    **dict.fromkeys(("on", "unnest", "where", "by", "having", "collect", "and", "or", "not", "in", *PATTERNS), "expression"), **dict.fromkeys(("aggregate", "select"), "block"),
    **dict.fromkeys((*REDUCERS, *FUNCTIONS, "rollup"), "arguments"),
}

KEYWORDS = frozenset((*CLAUSES, *GROUPING, *LOGIC, *PATTERNS, *REDUCERS, *LITERALS, *FUNCTIONS))


def manifest() -> dict:
    """The vocabulary as plain data, for editors."""
    groups = {"clause": CLAUSES, "grouping": GROUPING, "logic": LOGIC, "pattern": PATTERNS, "reducer": REDUCERS, "literal": LITERALS, "function": tuple(FUNCTIONS)}
    return {
        "keywords": [{"text": w, "group": g, "role": FOLLOWED_BY.get(w, "operator")} for g, words in groups.items() for w in words],
        "types": list(TYPES),
        "operators": [*COMPARISONS, *ARITHMETIC, "??"],
        "punctuation": [p for p in PUNCTUATION if p not in COMPARISONS and p not in ARITHMETIC and p != "??"],
        "functions": [{"name": n, "least": a, "most": b} for n, (a, b) in FUNCTIONS.items()],
    }
