"""Quality rules as weak supervision, in DataFrame operations only.

Every rule votes for or against a document, or abstains.  Nobody says which rules are right: expectation-maximisation
estimates from the votes of the whole corpus how often each rule is right about good and about bad documents, and with that
the probability that a document is good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from .text import WHITE_SPACE

# Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"

# Each rule is a measure, when it votes for and when against; else it abstains.  The measures are defined for any text with
# words; a text without any gets no votes and fails anyway.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols <= 0.02 * n_words", "n_symbols >= 0.1 * n_words"),
    "repeated_words": ("n_repeat_words <= 0.1 * n_words", "n_repeat_words >= 0.3 * n_words"),
    "repeated_lines": ("n_lines >= 3 AND n_dup_lines = 0", "n_dup_lines >= 0.2 * n_lines"),
    "capitals": ("n_capitals <= 0.08 * word_chars", "n_capitals >= 0.3 * word_chars"),
    "letters": ("n_alphanumeric >= 0.93 * word_chars", "n_alphanumeric <= 0.9 * word_chars"),
    "sentences": ("n_stops BETWEEN 0.02 * n_words AND 0.3 * n_words", "n_stops > 0.5 * n_words"),
    "exclamations": ("n_exclamations <= 0.02 * n_words", "n_exclamations >= 0.2 * n_words"),
    "variety": ("n_distinct >= 0.45 * n_words", "n_distinct <= 0.25 * n_words"),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ITERATIONS = 60


def _count(text: str, characters: str) -> str:
    """How often any of the characters occurs."""
    return " + ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in characters)


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc``, the ``carry`` columns (all if not given) as one, and the measures of every whole text.

    Words stand between ASCII white space.  ``word_chars`` counts code points in words, ``n_symbols`` the characters
    ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier line, ``n_repeat_words`` the words that lie in a
    window of three words which the text has twice or more.  Windows are told apart by 64-bit hashes within one text.
    ``n_alphanumeric`` counts letters, digits and the combining marks that many scripts write vowels with.

    All of a text is measured where its row is: nothing is exploded or shuffled.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("doc")
    measures = [
        "size(words)",
        "length(array_join(words, ''))",
        _count("text", SYMBOLS),
        "size(lines) - size(array_distinct(lines))",
        "size(lines)",
        "length(regexp_replace(text, r'[^\\p{L}\\p{M}\\p{N}]+', ''))",
        "length(regexp_replace(text, r'[^\\p{Lu}]+', ''))",
        _count("text", "!"),
        _count("text", ".") + " + " + _count("text", "!") + " + " + _count("text", "?"),
        "size(array_distinct(words))",
    ]
    names = "n_words word_chars n_symbols n_dup_lines n_lines n_alphanumeric n_capitals n_exclamations n_stops n_distinct".split()
    windows = "struct(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)) AS h, i AS i)"
    same = "coalesce(w.h = get(windows, j - 1).h, false) OR coalesce(w.h = get(windows, j + 1).h, false)"
    return (
        docs.select(doc, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .selectExpr(
            "doc",
            "text",
            rf"filter(split(text, r'{WHITE_SPACE}'), w -> w <> '') AS words",
            rf"filter(split(text, '\n'), l -> l RLIKE r'[^\x20\x09-\x0D]') AS lines",
        )
        .selectExpr(
            "doc",
            *[f"CAST({m} AS long) AS {n}" for n, m in zip(names, measures)],
            f"sort_array(if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> {windows}))) AS windows",
        )
        .selectExpr("doc", *names, f"transform(filter(windows, (w, j) -> {same}), w -> w.i) AS twice")
        .selectExpr(
            "doc",
            *names,
            "CAST(size(array_distinct(flatten(transform(twice, i -> array(i, i + 1, i + 2))))) AS long) AS n_repeat_words",
        )
    )


# The model: prior probability of a good document; for each rule, how often a vote on a good document is for it, and how
# often one on a bad document is against it.  There are many ways to be bad and a document shows few of them, so rules start
# with seeing a quarter; and a vote against is trusted: whatever the votes of others, no rule is taken to be wrong about
# more than one good document in TRUSTED, else frequent junk of one kind would pass for good.
TRUSTED = 50
_START = "named_struct('prior', 0.8D, 'good', array_repeat(0.99D, {k}), 'bad', array_repeat(0.25D, {k}))"
_GOOD = (
    "m.prior * aggregate(sequence(0, {k} - 1), 1D, (z, j) ->"
    " z * CASE get({v}, j) WHEN 1 THEN get(m.good, j) WHEN -1 THEN 1 - get(m.good, j) ELSE 1D END)"
)
_BAD = (
    "(1 - m.prior) * aggregate(sequence(0, {k} - 1), 1D, (z, j) ->"
    " z * CASE get({v}, j) WHEN -1 THEN get(m.bad, j) WHEN 1 THEN 1 - get(m.bad, j) ELSE 1D END)"
)


def _posterior(votes: str, k: int) -> str:
    good, bad = _GOOD.format(k=k, v=votes), _BAD.format(k=k, v=votes)
    return f"({good}) / ({good} + {bad})"


def _fitted(k: int, iterations: int) -> str:
    """Expectation-maximisation over ``patterns`` (``votes`` and the number ``n`` of documents with them), as one fold.

    Counts start at one vote for and one against, so no accuracy becomes 0 or 1.
    """

    def share(which: str, wanted: int, weight: str, least: float) -> str:
        def total(condition: str) -> str:
            return f"aggregate({which}, 0D, (z, p) -> z + if({condition}, p.n * {weight}, 0D))"

        return (
            f"transform(sequence(0, {k} - 1), j -> greatest({least}D, (1D + {total(f'get(p.votes, j) = {wanted}')})"
            f" / (2D + {total('get(p.votes, j) <> 0')})))"
        )

    total = "aggregate(e, 0D, (z, p) -> z + p.n{})"
    maximised = (
        f"named_struct('prior', (1D + {total.format(' * p.q')}) / (2D + {total.format('')}),"
        f" 'good', {share('e', 1, 'p.q', 1 - 1 / TRUSTED)}, 'bad', {share('e', -1, '(1 - p.q)', 0.0)})"
    )
    expected = (
        f"transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n, 'q', {_posterior('p.votes', k)}))"
    )
    # array(..)[0] names the expected values, which are used several times
    return f"aggregate(sequence(1, {iterations}), {_START.format(k=k)}, (m, i) -> get(transform(array({expected}), e -> {maximised}), 0))"


def fit(voted: DataFrame, rules: dict[str, tuple[str, str]] = RULES, iterations: int = ITERATIONS) -> DataFrame:
    """One row with ``patterns`` and the model ``m``, from the votes on all documents that did not fail already (``pattern`` and
    ``base_failed``, see :func:`judge`).

    Documents are counted by pattern of votes, of which there are at most 3 to the number of rules, 6,561 for eight.
    """
    k = len(rules)
    decoded = f"transform(sequence(0, {k} - 1), j -> CAST(pattern DIV CAST(power(3, j) AS long) AS int) % 3 - 1)"
    counted = voted.groupBy("pattern").agg(F.count_if(~F.col("base_failed")).alias("n"))
    patterns = counted.selectExpr("pattern", f"{decoded} AS votes", "CAST(n AS double) AS n").agg(
        F.array_sort(F.collect_list(F.struct("pattern", "votes", "n"))).alias("patterns")
    )
    return patterns.selectExpr("patterns", f"{_fitted(k, iterations)} AS m")


def judge(
    docs: DataFrame,
    carry: list[str] | None = None,
    rules: dict[str, tuple[str, str]] = RULES,
    threshold: float = 0.5,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """``doc`` (the ``carry`` columns, all if not given), its measures, ``base_failed``, ``probability`` that it is good, and
    ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated windows.  Such documents are never kept, and the
    model does not learn from them; others are kept if their probability reaches ``threshold``.

    Measures and votes are written to shared storage once, with the carried columns.  The table of patterns that comes
    back to the documents has a fixed bound (see :func:`fit`) and is broadcast.
    """
    votes = [f"CASE WHEN n_words = 0 THEN 1 WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END" for good, bad in rules.values()]
    pattern = " + ".join(f"{3**j} * ({v})" for j, v in enumerate(votes))
    voted = materialise(
        measured(docs, carry).selectExpr(
            "*",
            f"CAST({pattern} AS int) AS pattern",
            f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed",
        )
    )
    believed = (
        fit(voted, rules, iterations)
        .selectExpr("m", "explode(patterns) AS p")
        .selectExpr("p.pattern", f"{_posterior('p.votes', len(rules))} AS probability")
    )
    return voted.join(F.broadcast(believed), "pattern").withColumn(
        "kept", F.expr(f"NOT base_failed AND probability >= {threshold}")
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judge(docs, **options).where("kept").select("doc.*")
