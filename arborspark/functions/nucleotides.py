"""Scalar functions on alleles, codons and names, as native column expressions.

Alleles are one-hot sets: A=1, C=2, G=4, T=8; ambiguous letters are unions, unknown letters 15.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: IUPAC letters by allele set 1..15, and their complements
IUPAC = "ACMGRSVTWYHKDBN"
COMPLEMENT = ("ACGTMRWSYKVHDB", "TGCAKYWSRMBDHV")
# fixed values: the standard genetic code, codons in the order of bases T, C, A, G
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def allele(letter: Column) -> Column:
    """FN-1: letter -> set; unknown letters are 15."""
    at = F.call_function("instr", F.lit(IUPAC), F.upper(letter))
    return F.when((at > 0) & (F.length(letter) == 1), at).otherwise(15)


def letter(allele_set: Column) -> Column:
    """FN-1: set -> letter."""
    return F.substr(F.lit(IUPAC), allele_set.cast("int"), F.lit(1))


def bit_index(allele_set: Column) -> Column:
    """FN-1: one-hot set -> 0..3."""
    return F.log2(allele_set).cast("int")


def literal(par: Column, pos: Column, mut: Column) -> Column:
    """FN-2: A23403G; MASKED for negative positions."""
    return F.when(pos < 0, F.lit("MASKED")).otherwise(F.concat(letter(par), pos.cast("string"), letter(mut)))


LITERAL = r"^([A-Z])(\d+)([A-Z])$"


def parse_literal(text: Column) -> Column:
    """FN-2: struct(par, pos, mut), null where the text is no mutation."""
    part = lambda i: F.regexp_extract(text, LITERAL, i)
    return F.when(text.rlike(LITERAL), F.struct(allele(part(1)).alias("par"), part(2).cast("int").alias("pos"), allele(part(3)).alias("mut")))


def compatible(a: Column, b: Column) -> Column:
    """FN-3: two allele sets agree if they share an allele."""
    return a.bitwiseAND(b) != 0


def is_ambiguous(a: Column) -> Column:
    return F.bit_count(a) != 1


def first_allele(a: Column) -> Column:
    """FN-3: the lowest allele of a set."""
    return a.bitwiseAND(-a)


def impute(par: Column, mut: Column) -> Column:
    """FN-4: what parent and sample share, else the sample's lowest allele."""
    both = par.bitwiseAND(mut)
    return F.when(both != 0, both).otherwise(first_allele(mut))


def is_valid(par: Column, mut: Column) -> Column:
    """FN-5: an event that changes something."""
    return par != mut


def reversed_event(event: Column) -> Column:
    """FN-5: struct(pos, par, mut) turned round."""
    return F.struct(event["pos"].alias("pos"), event["mut"].alias("par"), event["par"].alias("mut"))


def split_chars(text: Column, separator: str) -> Column:
    """FN-6, QX-2: all fields, empty ones too."""
    return F.split(text, "\\Q" + separator + "\\E", -1)


def split_words(text: Column) -> Column:
    """FN-6: fields between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def log10_ratio(one: Column, two: Column) -> Column:
    """FN-13."""
    return F.log10(one / two)


def complement(seq: Column) -> Column:
    """FN-7; unknown letters become N."""
    upper = F.translate(seq, "acgtmrwsykvhdb", "ACGTMRWSYKVHDB")
    return F.translate(F.regexp_replace(upper, f"[^{COMPLEMENT[0]}]", "N"), *COMPLEMENT)


def amino_acid(codon: Column) -> Column:
    """FN-8: standard code; codons with other letters are X."""
    base = lambda i: F.call_function("instr", F.lit("TCAG"), F.substr(codon, F.lit(i), F.lit(1))) - 1
    at = base(1) * 16 + base(2) * 4 + base(3)
    known = codon.rlike("^[TCAG]{3}$")
    return F.when(known, F.substr(F.lit(AMINO_ACIDS), at + 1, F.lit(1))).otherwise("X")


def codon_mutate(codon: Column, pos: Column, start: Column, base: Column) -> Column:
    """FN-9: the codon with the base at a genomic position replaced; the index is |pos - start|."""
    return F.overlay(codon, base, F.abs(pos - start) + 1, F.lit(1))


def matches(name: Column, pattern: str) -> Column:
    """FN-10: full match."""
    return name.rlike(f"^(?:{pattern})$")


def country(name: Column) -> Column:
    """FN-11: what stands before the first slash."""
    return F.substring_index(name, "/", 1)


def sample_date(name: Column) -> Column:
    """FN-11: what stands after the last vertical bar."""
    return F.substring_index(name, "|", -1)


def max_descent(walk: Column) -> Column:
    """FN-17: largest fall of a walk over a string of A (+1) and B (-1)."""
    steps = F.transform(F.filter(F.split(walk, ""), lambda c: c.isin("A", "B")), lambda c: F.when(c == "A", 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"), F.lit(0).alias("fall"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        top = F.greatest(acc["top"], at)
        return F.struct(at.alias("at"), top.alias("top"), F.greatest(acc["fall"], top - at).alias("fall"))

    return F.aggregate(steps, zero, step, lambda acc: acc["fall"])


def log_factorials(n: int) -> Column:
    """Array literal of ln 0! .. ln n!; n is a bounded parameter."""
    import math

    return F.array(*(F.lit(math.lgamma(i + 1)) for i in range(n + 1)))


def fisher_exact(spark_table, a: str, b: str, c: str, d: str, out: str = "pvalue"):
    """FN-12: two-sided exact test of [[a, b], [c, d]]: sum of probabilities up to the observed one's."""
    @F.pandas_udf("double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        import numpy as np

        top = int((a + b + c + d).max()) + 1 if len(a) else 1
        lf = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))
        found = []
        for w, x, y, z in zip(a.astype(int), b.astype(int), c.astype(int), d.astype(int)):
            r1, r2, c1, n = w + x, y + z, w + y, w + x + y + z
            k = np.arange(max(0, c1 - r2), min(r1, c1) + 1)
            logp = lf[r1] + lf[r2] + lf[c1] + lf[n - c1] - lf[n] - lf[k] - lf[r1 - k] - lf[c1 - k] - lf[r2 - c1 + k]
            p = np.exp(logp)
            found.append(min(1.0, float(p[p <= p[k == w][0] * (1 + 1e-9)].sum())))
        return pd.Series(found, dtype="float64")

    return spark_table.withColumn(out, test(a, b, c, d))
