"""Metrics written as built-in Spark expressions.

A builder takes the prediction and the reference as `Text` views. Views name the
derived forms several metrics share (trimmed text, word list); `score` turns each
used form into one column, so the work is done once per row however many metrics
read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreframe.functions import text

Layers = tuple[dict[str, Column], dict[str, Column]]


class Text:
    """A text column and its derived forms.

    With `shared`, a derived form is recorded there under a column name and the view
    hands out a reference to that column; without, it is written in place. `shared`
    has two layers, because a form of the second one reads a form of the first.
    `touched` collects the names of the forms asked for.
    """

    def __init__(self, raw: Column, prefix: str = "", shared: Layers | None = None):
        self.raw = raw
        self.touched: set[str] = set()
        self._prefix = prefix
        self._shared = shared

    def _form(self, name: str, make: Callable[[], Column], layer: int = 0) -> Column:
        if self._shared is None:
            return make()
        column = f"__{self._prefix}_{name}"
        self.touched.add(column)
        if column not in self._shared[layer]:
            self._shared[layer][column] = make()
        return F.col(column)

    @property
    def stripped(self) -> Column:
        return self._form("stripped", lambda: text.strip(self.raw))

    @property
    def number(self) -> Column:
        stripped = self.stripped
        return self._form("number", lambda: text.to_number(stripped), layer=1)

    @property
    def lower_words(self) -> Column:
        return self._form("lower_words", lambda: text.words(F.lower(self.raw)))

    @property
    def word_count(self) -> Column:
        # Case changes no white space, so counting shares the words of `word_set`.
        words = self.lower_words
        return self._form("word_count", lambda: F.array_size(words), layer=1)

    @property
    def word_set(self) -> Column:
        words = self.lower_words
        return self._form("word_set", lambda: F.array_distinct(words), layer=1)

    def item_set(self, delimiter: str) -> Column:
        name = "items_" + "_".join(str(ord(c)) for c in delimiter)
        return self._form(name, lambda: text.items(self.raw, delimiter))


def _by_presence(got: Column, want: Column, both: Column) -> Column:
    """1 if both sides are empty, 0 if one is, else `both`; NULL stays NULL."""
    return (
        F.when((got == 0) & (want == 0), F.lit(1.0))
        .when((got == 0) | (want == 0), F.lit(0.0))
        .when(got.isNotNull() & want.isNotNull(), both)
    )


def exact_match(prediction: Text, reference: Text) -> Column:
    return (prediction.stripped == reference.stripped).cast("double")


def exact_match_figure(prediction: Text, reference: Text) -> Column:
    """Equal as numbers; text that is no number scores 0, and so does NaN."""
    got, want = prediction.number, reference.number
    same = (got == want) & ~F.isnan(got)
    return F.when(
        prediction.raw.isNotNull() & reference.raw.isNotNull(),
        F.coalesce(same, F.lit(False)).cast("double"),
    )


def contains_answer(prediction: Text, reference: Text) -> Column:
    return F.contains(prediction.stripped, reference.stripped).cast("double")


def set_f1(prediction: Text, reference: Text, delimiter: str = "\n") -> Column:
    got, want = prediction.item_set(delimiter), reference.item_set(delimiter)
    common = F.array_size(F.array_intersect(got, want))
    sizes = F.array_size(got), F.array_size(want)
    return _by_presence(*sizes, F.lit(2.0) * common / (sizes[0] + sizes[1]))


def jaccard_similarity(prediction: Text, reference: Text) -> Column:
    got, want = prediction.word_set, reference.word_set
    common = F.array_size(F.array_intersect(got, want))
    sizes = F.array_size(got), F.array_size(want)
    return _by_presence(*sizes, common / (sizes[0] + sizes[1] - common))


def word_count_similarity(prediction: Text, reference: Text) -> Column:
    got, want = prediction.word_count, reference.word_count
    return _by_presence(got, want, 1 - F.abs(got - want) / F.greatest(got, want))


def length_ratio(prediction: Text, reference: Text) -> Column:
    """Shorter over longer character length; an empty text only matches another."""
    got, want = F.char_length(prediction.raw), F.char_length(reference.raw)
    return _by_presence(got, want, F.least(got, want) / F.greatest(got, want))


def weighted_match(
    prediction: Text, reference: Text, weight: float = 0.5, case_sensitive: bool = False
) -> Column:
    got, want = prediction.stripped, reference.stripped
    if not case_sensitive:
        got, want = F.lower(got), F.lower(want)
    return F.when(got == want, F.lit(float(weight))).when(got != want, F.lit(0.0))
