"""Prompt templates and answer clean-up as column expressions.

The texts below must equal the corpus they were used for, so they are kept as
fixed values; rendering picks them by (genre, level).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Persona per genre.
PERSONAS = {
    "Academic": "You are a university researcher skilled in analyzing, summarizing, and generating academic writing using precise and structured arguments.",
    "Blogs": "You are an experienced content creator who writes engaging, reflective, and relatable blog posts that connect with readers personally.",
    "News": "You are a professional journalist trained to write concise, neutral, and factual articles that adhere to high editorial standards.",
}
DEFAULT_PERSONA = "You are a clear and insightful writer who communicates ideas effectively."

# Fixed values: (input, output) examples per genre.
EXAMPLES = {
    "Academic": [
        ("AI ethics focuses on fairness and transparency.",
         "AI ethics emphasizes fairness, accountability, and transparency as core principles in responsible innovation."),
        ("Renewable energy reduces carbon emissions.",
         "The global transition to renewable energy has significantly reduced carbon emissions, reshaping industrial policies worldwide."),
    ],
    "Blogs": [
        ("Morning routines improve focus.",
         "Starting the day with a structured morning routine helps boost clarity, motivation, and productivity."),
        ("Traveling broadens perspectives.",
         "Exploring new places expands one's understanding of cultures and encourages personal growth through new experiences."),
    ],
    "News": [
        ("Global leaders discuss emission reduction strategies.",
         "World leaders convened to negotiate new frameworks aimed at reducing global emissions and advancing renewable energy policy."),
        ("Stock markets show mixed trends amid inflation fears.",
         "Global markets displayed mixed performance this week as investors weighed inflation data against central bank signals."),
    ],
}

# System prompts of the extraction step; {persona} and {examples} are filled in.
EXTRACTION = {
    1: "You are a careful text analyst.\nYour task is to read a human-written text and return:\n- 5 key domain-specific keywords or phrases (lowercase)\n"
       "- 1-sentence concise summary (<=30 words)\n- the approximate word count of the text",
    2: "{persona}\nYour task is to analyze the following human-written text and extract:\n- 5 domain-relevant keywords or phrases (lowercase)\n"
       "- a one-sentence summary (<=30 words)\n- the approximate word count of the text",
    3: "{persona}\nBelow are examples of how you have previously analyzed texts:\n\n{examples}\n\nNow, analyze the new text in the same style and format.",
}

# Request format of the extraction step.
USER_HEAD = "HUMAN METADATA\n- genre: %s\n- subfield: %s\n- year: %s\n- level: LV%s\n- model: %s\n%s\n\nHUMAN TEXT\n\"\"\"%s\"\"\"\n\n"
USER_TAIL = (
    "Return strict JSON:\n{\n  \"keywords\": [\"keyword1\", \"keyword2\", \"keyword3\", \"keyword4\", \"keyword5\"],\n"
    "  \"summary\": \"one-sentence summary\",\n  \"word_count\": 123\n}"
)

# Generation preambles and styles.
PREAMBLES = {
    1: "Write an original text inspired by these ideas.",
    2: "{persona}",
    3: "{persona}\nBelow are writing examples from this genre:\n\n{examples}\n\nNow create a new text inspired by the given summary and keywords.",
}
STYLES = {
    "Academic": "Write a formal academic-style abstract in the field of %1$s. Use precise terminology and structured reasoning (~%2$s words). Year context: %3$s.",
    "Blogs": "Write a reflective blog post related to %1$s. Use a conversational tone and clear storytelling (~%2$s words). Year context: %3$s.",
    "News": "Write a news article about %1$s. Maintain objectivity, factual balance, and professional tone. CRITICAL: The article must be between %4$s and %5$s words "
            "(target: %2$s words, ±5%% tolerance). Year context: %3$s. Count your words carefully and ensure the final article is within this range.",
}

# Sentences with these phrases talk about the task, not the content.
TASK_PHRASES = [
    "task is to", "your task is", "you are asked", "instruction", "please summarize", "summarize the text", "summarize this text",
    "read the text", "given text", "provided text", "the text does not", "the original response", "not applicable", "no article to summarize",
    "no article available", "no passage to rewrite", "there is no article", "there is no text", "response is not applicable",
]


def examples_text(genre: str) -> str:
    return "\n\n".join(f"Example:\nInput: {i}\nOutput: {o}" for i, o in EXAMPLES.get(genre, []))


def template_rows(templates: dict[int, str]) -> list[tuple[str, int, str]]:
    """(genre, level, text) rows of the template dimension table."""
    return [
        (g, level, t.format(persona=PERSONAS[g], examples=examples_text(g)) if level > 1 else t)
        for g in PERSONAS for level, t in templates.items()
    ]


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extraction_request(genre: Column, subfield: Column, year: Column, level: Column, model: Column, identifier: Column, text: Column) -> Column:
    ident = F.when(identifier != "", F.concat(F.lit("- identifier: "), identifier, F.lit("\n"))).otherwise("")
    head = F.format_string(USER_HEAD, genre, subfield, year.cast("string"), level.cast("string"), model, ident, strip_space(text))
    return F.concat(head, F.lit(USER_TAIL))


def generation_request(genre: Column, preamble: Column, subfield: Column, year: Column, keywords: Column, summary: Column, words: Column) -> Column:
    low, high = F.greatest(F.lit(1), F.floor(words * 0.95)), F.floor(words * 1.05)
    args = [subfield, words.cast("string"), year.cast("string"), low.cast("string"), high.cast("string")]
    style = F.when(genre == "Academic", F.format_string(STYLES["Academic"], *args)).when(
        genre == "Blogs", F.format_string(STYLES["Blogs"], *args)).when(genre == "News", F.format_string(STYLES["News"], *args))
    base = F.format_string("Here is a summary of a human-written %s text:\n\nKeywords: %s\nSummary: %s\n", F.lower(genre), F.array_join(keywords, ", "), summary)
    return F.concat(base, F.lit("\n\n"), preamble, F.lit("\n\n"), style)


def max_tokens(words: Column, news: bool = False) -> Column:
    """min(2000, 1.5 w); news: 1.05 w in words, times 1.33 and 1.1, within 500..15000."""
    if not news:
        return F.least(F.lit(2000), F.floor(words * 1.5)).cast("int")
    return F.greatest(F.lit(500), F.least(F.lit(15000), F.floor(F.floor(words * 1.05) * 1.33 * 1.1))).cast("int")


def metadata_block(prompt: Column) -> Column:
    """Map of the '- key: value' lines between the metadata and text headings."""
    block = F.regexp_extract(prompt, r"(?s)HUMAN METADATA(.*?)HUMAN TEXT", 1)
    lines = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-([^\n:]*:[^\n]*)$"), F.lit(1))
    pairs = F.transform(lines, lambda line: F.struct(
        F.lower(F.trim(F.substring_index(line, ":", 1))).alias("k"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


def normal_keywords(value: Column) -> Column:
    """At most five trimmed, lower-case, non-empty keywords of an array."""
    clean = F.filter(F.transform(value, lambda k: F.lower(strip_space(k))), lambda k: k != "")
    return F.slice(F.coalesce(clean, F.array().cast("array<string>")), 1, 5)


def split_keywords(value: Column) -> Column:
    """Keywords of a comma-separated string."""
    return normal_keywords(F.split(value, ","))


def normal_word_count(value: Column, fallback_text: Column) -> Column:
    """A positive whole number, else the number of whitespace words of the text."""
    n = value.try_cast("int")
    return F.when(n > 0, n).otherwise(F.regexp_count(fallback_text, F.lit(r"\S+")))


def _tasky(sentence: Column) -> Column:
    low = F.lower(sentence)
    hit = F.lit(False)
    for p in TASK_PHRASES:
        hit = hit | F.contains(low, F.lit(p))
    return hit


def fallback_summary(answer: Column, original: Column, max_words: int = 30) -> Column:
    """First sentence about the content, at most 30 words.

    A sentence about the task is used only when there is no other, and then
    gives way to the first sentence of the original text.
    """
    cut = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?<=[.!?])\s+"), lambda s: s != "")
    own = F.get(F.filter(cut(answer), lambda s: ~_tasky(s)), F.lit(0))
    best = F.coalesce(own, F.get(cut(original), F.lit(0)), F.get(cut(answer), F.lit(0)), F.lit(""))
    return F.array_join(F.slice(F.split(best, " "), 1, max_words), " ")
