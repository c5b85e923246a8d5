"""The lexicons that come with the package."""

from __future__ import annotations

from proseline.functions.lexicon import Entry, Lexicon

# The phrases, patterns and exceptions of the style guide; its version, and the digest of its content with all examples.
ENGLISH = Lexicon(
    "en",
    "0.3.0",
    {
        "weasel-words": (
            Entry("experts say"),
            Entry("many believe"),
            Entry("reports suggest"),
            Entry("critics argue"),
            Entry("it is widely"),
        ),
        "editorializing": (
            Entry("it's important to note"),
            Entry("it's worth mentioning"),
            Entry("in this article we"),
        ),
        "promotional-tone": (
            Entry("incredible"),
            Entry("stunning"),
            Entry("breathtaking"),
            Entry("must-try"),
        ),
        "inflated-vocabulary": (
            Entry("delve"),
            Entry("landscape", unless=("landscape orientation", "landscape mode", "landscape photography")),
            Entry("synergy"),
            Entry("empower"),
            Entry("leverage"),
            Entry("robust"),
            Entry("seamless"),
            Entry("tapestry"),
        ),
        "summary-close": (
            Entry("in conclusion"),
            Entry("all in all"),
            Entry("to summarize"),
        ),
        "transition-density": (
            Entry("moreover"),
            Entry("furthermore"),
            Entry("additionally"),
            Entry("however"),
            Entry("on the other hand"),
        ),
        "negative-parallelism": (
            Entry(r"(?<![\p{L}])not\s+just(?![\p{L}])[^.!?\n]{0,80}?(?<![\p{L}])but(?![\p{L}])", "pattern", needs=("not", "just", "but"), quick=r"(?=n)(?<![\p{L}])not\s+just(?![\p{L}])[^.!?\n]{0,80}?(?<![\p{L}])but(?![\p{L}])"),
            Entry(r"(?<![\p{L}])it[’']?s\s+not(?![\p{L}])[^.!?\n]{0,60}?,\s*it[’']?s(?![\p{L}])", "pattern", needs=("not", ","), quick=r"(?=i)(?<![\p{L}])it[’']?s\s+not(?![\p{L}])[^.!?\n]{0,60}?,\s*it[’']?s(?![\p{L}])"),
        ),
        "rule-of-three": (
            Entry(r"(?<![\p{L}])\p{L}{3,}(?:[ \t]+\p{L}+){0,2},\s+\p{L}{3,}(?:[ \t]+\p{L}+){0,2},?\s+and\s+\p{L}{3,}(?![\p{L}])", "pattern", needs=(",", "and"), quick=r"(?<![\p{L}])\p{L}{3,}+(?:[ \t]++\p{L}++){0,2}+,\s++\p{L}{3,}+(?:[ \t]++\p{L}++){0,2},?\s++and\s++\p{L}{3,}+(?![\p{L}])", sure=r",\s++\p{L}{3,}+(?:[ \t]++\p{L}++){0,2},?\s++and\s"),
        ),
    },
    {
        "participial-close": (
            "nothing",
            "something",
            "anything",
            "everything",
            "during",
            "morning",
            "evening",
        ),
    },
    digest="0126033ab30f",
)

SERBIAN = Lexicon(
    "sr",
    "0.3.0",
    {
        "weasel-words": (
            Entry("stručnjaci kažu"),
            Entry("mnogi smatraju"),
            Entry("izveštaji pokazuju"),
            Entry("neki kritičari tvrde"),
        ),
        "editorializing": (
            Entry("važno je napomenuti"),
            Entry("vredi pomenuti"),
            Entry("u ovom tekstu"),
        ),
        "promotional-tone": (
            Entry("neverovat*"),
            Entry("zadivljujuć*"),
            Entry("spektakular*"),
            Entry("obavezno isprobati"),
        ),
        "inflated-vocabulary": (
            Entry("zaroniti"),
            Entry("kompleks*"),
            Entry("pejzaž"),
            Entry("sinergij*"),
            Entry("osnažiti"),
            Entry("unaprediti"),
            Entry("ključ*", unless=("ključna reč", "ključne reči", "ključnu reč", "ključnih reči", "ključnim rečima")),
        ),
        "summary-close": (
            Entry("sve u svemu"),
            Entry("u zaključku"),
            Entry("da rezimiramo"),
        ),
        "transition-density": (
            Entry("sa druge strane"),
            Entry("štaviše"),
            Entry("pored toga"),
            Entry("dodatno"),
            Entry("međutim"),
            Entry("nasuprot tome"),
        ),
        "negative-parallelism": (
            Entry(r"(?<![\p{L}])nije(?![\p{L}])[^.!?\n]{0,80}?(?<![\p{L}])(već|nego)(?![\p{L}])", "pattern", needs=("nije",), quick=r"(?=n)(?<![\p{L}])nije(?![\p{L}])[^.!?\n]{0,80}?(?<![\p{L}])(već|nego)(?![\p{L}])"),
            Entry(r"(?<![\p{L}])ne\s+samo(?![\p{L}])[^.!?\n]{0,80}?(?<![\p{L}])(već|nego)(?![\p{L}])", "pattern", needs=("samo",), quick=r"(?=n)(?<![\p{L}])ne\s+samo(?![\p{L}])[^.!?\n]{0,80}?(?<![\p{L}])(već|nego)(?![\p{L}])"),
        ),
        "rule-of-three": (
            Entry(r"(?<![\p{L}])\p{L}{3,}(?:[ \t]+\p{L}+){0,2},\s+\p{L}{3,}(?:[ \t]+\p{L}+){0,2}\s+i\s+\p{L}{3,}(?![\p{L}])", "pattern", needs=(",", "i"), quick=r"(?<![\p{L}])\p{L}{3,}+(?:[ \t]++\p{L}++){0,2}+,\s++\p{L}{3,}+(?:[ \t]++\p{L}++){0,2}\s++i\s++\p{L}{3,}+(?![\p{L}])", sure=r",\s++\p{L}{3,}+(?:[ \t]++\p{L}++){0,2}\s++i\s"),
        ),
    },
    {
        "verbal-adverb-close": (
            "reći",
            "doći",
            "poći",
            "naći",
            "moći",
            "pomoći",
            "proći",
            "otići",
            "preći",
            "sići",
            "izaći",
            "stići",
            "postići",
            "dostići",
            "seći",
            "preseći",
            "odseći",
            "iseći",
            "teći",
            "poteći",
            "isteći",
            "vući",
            "izvući",
            "privući",
            "navući",
            "peći",
            "ispeći",
            "leći",
            "tući",
            "obući",
            "svući",
            "zateći",
        ),
    },
    digest="a1e590743b64",
)

SHIPPED = {"en": ENGLISH, "sr": SERBIAN}

# Function words whose presence votes for a language, and letters with diacritics.
STOPWORDS = {
    "sr": ["je", "da", "se", "na", "za", "su", "sa", "ali", "ili", "kao", "koji", "koje", "ovo", "to", "nije", "bi", "ga", "im", "od", "pa"],
    "en": ["the", "of", "and", "to", "is", "in", "that", "it", "for", "with", "as", "this", "are", "was", "but", "not", "you", "be", "have", "from"],
}
DIACRITICS = "šđčćžŠĐČĆŽ"
