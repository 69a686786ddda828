"""Budgets of model calls and the classification of their errors, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens, truncated_middle

#: Context sizes that a model's name tells, in the order in which they are looked for.
WINDOWS = [("128k|131072", 131072), ("32k|32768", 32768), ("16k|16384", 16384), ("8k|8192", 8192), ("4k|4096", 4096)]
DEFAULT_WINDOW, RAW_BUDGET, OUTPUT, CHUNK = 8192, 6000, 1500, 1500


def context_window(model: Column) -> Column:
    found = F.lit(DEFAULT_WINDOW)
    for pattern, size in reversed(WINDOWS):
        found = F.when(F.lower(model).rlike(pattern), F.lit(size)).otherwise(found)
    return found


def _part(window: Column, percent: int) -> Column:
    return F.floor(window * percent / 100).cast("int")


def limits(model: Column) -> Column:
    """context, raw, reserve, sot and chunk tokens of a model."""
    window = context_window(model)
    raw = F.least(F.lit(RAW_BUDGET), _part(window, 35))
    reserve = F.greatest(F.lit(1024), F.least(F.lit(OUTPUT), _part(window, 18)))
    return F.struct(
        window.alias("context_tokens"), raw.alias("raw_tokens"), reserve.alias("reserve_tokens"),
        F.greatest(F.lit(800), window - raw - reserve - 800).alias("sot_tokens"),
        F.greatest(F.lit(400), F.least(F.lit(CHUNK), raw)).alias("chunk_tokens"),
    )


def request(model: Column, *prompts: Column, reserved: int = 2048) -> Column:
    """Whether a request fits; what is reserved for the answer counts on both sides."""
    usable = _part(context_window(model), 80) - reserved
    projected = sum((tokens(p) for p in prompts), F.lit(reserved))
    return F.struct((projected < usable).alias("fits"), projected.alias("projected"), usable.alias("usable"), F.greatest(F.lit(0), projected - usable).alias("overflow"))


def error_class(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: [m.contains(w) for w in words]
    memory, (context, exceed, length), (timeout, timed) = has("out of memory", "oom"), has("context", "exceed", "length"), has("timeout", "timed out")
    return F.when(memory[0] | memory[1], "oom").when(context & (exceed | length), "context").when(timeout | timed, "recoverable").otherwise("fatal")


def model_rank(model: Column) -> Column:
    """Order of preference: instruct or chat models, others, vision, embedding."""
    low = F.lower(model)
    return F.when(low.rlike("embed|e5-"), 99).when(low.rlike("vl|vision|multimodal|mm-"), 10).when(low.rlike("instruct|chat"), 0).otherwise(5)


def percent(done: Column, total: Column, most: int) -> Column:
    """Share in whole percents, halves to even, `most` at most; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(most), F.bround(done / total * 100, 0).cast("int"))).otherwise(0)


def fitted_prompt(model: Column, system: Column, user: Column, output: int, margin: int = 128) -> Column:
    """The user's part of a prompt, cut in its middle if both parts don't fit beside the answer."""
    x = limits(model)
    room = x["context_tokens"] - x["reserve_tokens"] - output - margin
    most = F.greatest(F.lit(256), room - tokens(system)) * 4
    return F.when((tokens(F.concat(system, user)) <= room) | (room < 256), user).otherwise(truncated_middle(user, most, "prompt_utente"))


MOST_CHUNKS = 250


def document_state(total: Column, context: Column, chunk: Column) -> Column:
    """ok, or why a document of so many tokens isn't begun: it takes over 55 % of the context, or too many chunks."""
    chunks = F.greatest(F.lit(1), F.ceil(total / chunk))
    return F.when(total > F.floor(context * 55 / 100), "over_context").when(chunks > MOST_CHUNKS, "too_many_chunks").otherwise("ok")


def fitted_payload(context: Column, system: Column, user: Column, output: int, label: str, margin: int = 128) -> Column:
    """The user's part of a call and its state: ok, cut in its middle, no_room (under 256 tokens are left), or over even when cut."""
    room = context - tokens(system) - output - margin
    short = F.when(tokens(user) > room, truncated_middle(user, F.greatest(room, F.lit(256)) * 4, label)).otherwise(user)
    state = F.when(room < 256, "no_room").when(tokens(short) > room, "over").when(tokens(user) > room, "cut").otherwise("ok")
    return F.struct(F.when(room >= 256, short).alias("user"), state.alias("state"))


def synthesis_budget(model: Column) -> Column:
    """65 % of a model's context; 5,000 tokens where no model is named."""
    return F.when(model.isNull(), 5000).otherwise(_part(context_window(model), 65))


def shrunk(text: Column, fits: Column, usable: Column, projected: Column) -> Column:
    """A prompt for the next try: cut to the share that is usable, 0.7 of it at most and 256 code points at least."""
    ratio = F.least(F.lit(0.7), usable / F.greatest(projected, F.lit(1)))
    return F.when(fits | (usable <= 0), text).otherwise(F.substring(text, F.lit(1), F.greatest(F.lit(256), (F.length(text) * ratio).cast("int"))))


#: Words of a model's name by task, in the order in which they are looked for.
TASKS = {"reasoning": ["qwen", "deepseek", "mistral-nemo", "llama-3"], "summary": ["phi", "gemma", "llama-3.2"], "fast": ["phi", "smollm", "qwen2.5-3b"]}


def model_for(task: str, models: Column) -> Column:
    """Of an ordered array of models the first that a word of the task names, word by word; else the first that doesn't see; else the first."""
    first = lambda word: F.get(F.filter(models, lambda m: F.contains(F.lower(m), F.lit(word))), F.lit(0))
    named = [first(word) for word in TASKS.get(task, [])]
    blind = F.get(F.filter(models, lambda m: ~F.lower(m).rlike("vl|vision|multimodal|mm-")), F.lit(0))
    return F.coalesce(*named, blind, F.get(models, F.lit(0)))


def discovered(models: Column, fallback: str) -> Column:
    """The model to use from structs (model, loaded, state): one that is loaded, by preference; one in use; the only one;
    the first by preference; else the fallback. Embedding models never count."""
    chat = F.filter(models, lambda m: ~F.lower(m["model"]).rlike("embed|e5-"))
    by_rank = lambda xs: F.get(F.array_sort(F.transform(xs, lambda m: F.struct(model_rank(m["model"]).alias("r"), m["model"].alias("model")))), F.lit(0))["model"]
    used = F.get(F.filter(chat, lambda m: F.lower(m["state"]).isin("loaded", "active", "running")), F.lit(0))["model"]
    return F.coalesce(by_rank(F.filter(chat, lambda m: m["loaded"])), used, by_rank(chat), F.lit(fallback))
