"""Row-wise functions on nucleotide sequences and words (8-mers), as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 8
WORD_SPACE = 4**K
SKETCH, BAND = 32, 4
#: The IUPAC letters that stay as they are.
IUPAC = "ACGTRYSWKMBDHVN"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTRYKMBVDH", "TGCAYRMKVBHD"


def ascii_upper(seq: Column) -> Column:
    """Upper case in a-z only."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def by_byte(seq: Column) -> Column:
    """The text with every byte of its UTF-8 form as one character, as sequences count bytes."""
    return F.decode(F.encode(seq, "UTF-8"), "ISO-8859-1")


def normalize(seq: Column) -> Column:
    """U becomes T; letters outside IUPAC become N."""
    return F.regexp_replace(F.translate(ascii_upper(by_byte(seq)), "U", "T"), f"(?s)[^{IUPAC}]", "N")


def unknown(seq: Column) -> Column:
    """Bytes that normalize() doesn't know."""
    return F.length(by_byte(seq)) - F.length(F.regexp_replace(ascii_upper(by_byte(seq)), f"(?s)[^{IUPAC}U]", ""))


def ambiguous(normalized: Column) -> Column:
    """Letters other than A, C, G, T."""
    return F.length(normalized) - F.length(F.translate(normalized, "RYSWKMBDHVN", ""))


def words(normalized: Column) -> Column:
    """Every 8-mer of A, C, G, T, in order, repeats included."""
    every = F.transform(F.sequence(F.lit(1), F.length(normalized) - (K - 1)), lambda i: F.substring(normalized, i, F.lit(K)))
    plain = F.filter(every, lambda w: F.length(F.translate(w, "ACGT", "")) == 0)
    return F.when(F.length(normalized) >= K, plain).otherwise(F.array().cast("array<string>"))


def vocabulary(normalized: Column) -> Column:
    """The different words, ascending (string order is code order)."""
    return F.array_sort(F.array_distinct(words(normalized)))


def reverse_complement(normalized: Column) -> Column:
    return F.reverse(F.translate(normalized, COMPLEMENT_FROM, COMPLEMENT_TO))


def word_code(word: Column) -> Column:
    """The 16-bit code of a word: two bits a base, A 0, C 1, G 2, T 3."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("long")


def letters(code: Column) -> Column:
    """The word of a code."""
    return F.translate(F.lpad(F.conv(code, 10, 4), K, "0"), "0123", "ACGT")


def permuted(code: Column) -> Column:
    """A one-to-one 16-bit hash of a code; the shifts and factors are fixed values."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFF))
    x = low(code.cast("long"))
    x = x.bitwiseXOR(F.shiftright(x, 8))
    x = low(x * F.lit(0x88B5))
    x = x.bitwiseXOR(F.shiftright(x, 7))
    x = low(x * F.lit(0xE1B5))
    return x.bitwiseXOR(F.shiftright(x, 9))



def sketch(vocab: Column) -> Column:
    """The 32 smallest hashes of the words, ascending: the twin of words.sketch, which is far faster, as
    inside a lambda every step of the hash is evaluated anew for each time it is named."""
    return F.slice(F.array_sort(F.transform(vocab, lambda w: permuted(word_code(w)))), 1, SKETCH)


def band(sketch_: Column, b: int) -> Column:
    """Four consecutive values as a key; null where the sketch is too short."""
    return F.when(F.size(sketch_) >= BAND * (b + 1), F.array_join(F.slice(sketch_, BAND * b + 1, BAND), ","))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the 32 smallest values of the union that both hold; 0 for two empty sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 0.0).otherwise(both.cast("double") / F.size(union))
