"""Prompts for the three questions that a language model is asked, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAN_SYSTEM = "You plan how finely a document should be cut into passages for search. Answer with one JSON object and nothing else."
CHECK_SYSTEM = (
    "You judge whether a passage break separates two subjects. Keep breaks between distinct subjects; merge only where the second part "
    "continues one thought, leans on the first by words such as this, both or these, or makes no sense alone. In doubt, keep. "
    "Answer with one JSON object and nothing else."
)
ENRICH_SYSTEM = "You describe a passage so that people can find it. Answer with one JSON object and nothing else."


#: What the answer to each question has to hold.
PLAN_KEYS = (
    "Reply with the keys topics (list of 6 to 20 brief ones), expected_chunk_count, expected_chunk_count_range ([low, high], both at least 1), "
    "atomize_sentences_per_paragraph (0 for none, or 2 to 6), atomize_min_sentences (4 to 12), rationale (brief), confidence (0 to 1)."
)
ENRICH_KEYS = (
    "Reply with the keys title, summary (one or two sentences), intent (explains, lists, warns, defines, instructs or compares), "
    "questions (list, in which the key terms occur), keywords (list)."
)


def plan_prompt(file_type: Column, titles: Column, lines: Column, paragraphs: Column, sections: Column, config) -> Column:
    """What is known of a document's shape, and the keys wanted back."""
    limits = f"Similarity threshold {config.similarity_threshold}; passages of {config.min_chunk_tokens} to {config.max_chunk_tokens} tokens are wanted.\n"
    return F.concat(
        F.lit("File type: "), file_type, F.lit("\nParagraphs: "), paragraphs.cast("string"), F.lit("\nSections: "), sections.cast("string"), F.lit(" "), titles,
        F.lit("\n" + limits + "Long paragraphs can be cut into groups of sentences, atoms, before breaks are looked for.\nSample:\n"), lines, F.lit("\n" + PLAN_KEYS),
    )


def check_prompt(before: Column, after: Column) -> Column:
    keys = 'Reply with the keys verdict ("KEEP", "MERGE" or "ADJUST"), reason, confidence (0 to 1).'
    return F.concat(F.lit("Before the break:\n<<<\n"), before, F.lit("\n>>>\nAfter the break:\n<<<\n"), after, F.lit("\n>>>\n" + keys))


def enrich_prompt(content: Column, section: Column) -> Column:
    shown = F.when(F.coalesce(section, F.lit("")) == "", F.lit("Document Root")).otherwise(section)
    return F.concat(F.lit("Section: "), shown, F.lit("\nPassage:\n<<<\n"), content, F.lit("\n>>>\n" + ENRICH_KEYS))
