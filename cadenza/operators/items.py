"""Operators that take their parameters per item: a DataFrame of parameters by the signals' keys, or columns."""

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import gumbel, uniform
from ..sources.tables import spread
from . import filters
from .decode import softmax, top_k, top_p
from .levels import peak_limited
from .scan import filtered, one_pole_sections, weighted


def long_and_fast(rows: DataFrame, seconds: float, rate: int) -> DataFrame:
    return rows.filter((F.col("duration") >= seconds) & (F.col("sample_rate") >= rate))


def noise_or_response(path: Column) -> Column:
    """Recordings of rooms by name: those with "noise" in it are noise, the rest impulse responses."""
    return F.when(F.lower(path).contains("noise"), "noise").otherwise("response")


def all_but(every: DataFrame, some: DataFrame) -> DataFrame:
    """Distinct rows of ``every`` that are not in ``some``."""
    return every.distinct().join(some.distinct(), every.columns, "left_anti")


def checkpoint_tags(steps: DataFrame, save: list[int]) -> DataFrame:
    """``tags`` of each ``step, loss``: latest, best if no earlier loss is lower, and the step itself if asked for.

    One row a validation run, so the window over all of them is small.
    """
    best = F.col("loss") <= F.min("loss").over(W.orderBy("step"))
    step = F.when(F.col("step").isin(save), F.col("step").cast("string"))
    return steps.select("step", "loss", F.concat_ws(",", F.lit("latest"), F.when(best, "best"), step).alias("tags"))


def off_at(value: Column, *off) -> Column:
    """Null at the values that switch the parameter off."""
    return F.when(~value.isin(*off), value)


def or_default(value: Column, default) -> Column:
    """The default for null and for zero."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def per_codebook(value: Column, codebooks: int) -> Column:
    """One entry for each codebook: an array of that size, or of one entry that is repeated; else an error."""
    fits = F.when(F.size(value) == codebooks, value).when(F.size(value) == 1, F.array_repeat(value[0], codebooks))
    return F.coalesce(fits, F.raise_error(F.lit(f"one value or {codebooks} asked for")).cast("array<int>"))


def is_known(value: Column) -> Column:
    return value.isNotNull()


def token_length(frames: int, length: Column, longest: Column) -> Column:
    """Tokens of an item whose signal has ``length`` of ``longest`` samples on a grid of ``frames``."""
    return F.floor(F.lit(frames) * length / longest)


def stem_counters(rows: DataFrame, rate: int) -> DataFrame:
    """Per stem of ``track, stem, seconds, written``: samples of the longest file, files and tracks written."""
    done = F.col("written")
    return rows.groupBy("stem").agg(F.max((F.col("seconds") * rate).cast("long")).alias("longest"), F.count_if(done).alias("written"), F.count_distinct(F.when(done, F.col("track"))).alias("tracks"))


def last_and_mean(rows: DataFrame, key: str, batch: str, metric: str) -> DataFrame:
    """A metric of each run's last batch, and its mean over batches."""
    return rows.groupBy(key).agg(F.max_by(metric, batch).alias("last"), F.avg(metric).alias("mean"))


def side_chain(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """One channel that a compressor listens to: the channels' sum, or their largest magnitude."""
    if kind not in ("sum", "peak"):
        raise ValueError(f"unknown side chain {kind}")
    return rows.groupBy(*keys, "t").agg((F.sum("x") if kind == "sum" else F.max(F.abs("x"))).alias("x"))


def parameter_count(tensors: DataFrame) -> DataFrame:
    """Sum of the products of all ``shape`` arrays."""
    return tensors.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)).alias("parameters"))


def ms_to_frames(ms: Column, rate: int, hop: int) -> Column:
    return F.greatest(F.lit(1), F.rint(ms / 1000 * rate / hop)).cast("long")


def per_distinct(rows: DataFrame, keys: list[str], *work: Column) -> DataFrame:
    """Work done once for each distinct value, and how many rows use it."""
    return rows.groupBy(*keys).agg(*work, F.count("*").alias("uses"))


def gathered(rows: DataFrame, at: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Rows at the indices that ``at`` names for each key."""
    return at.join(rows, [*keys, index])


# parameters by item


def with_params(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``params``, one row for each key."""
    return df.join(params, keys)


def delayed(df: DataFrame, params: DataFrame, keys: list[str], taps: int, rate: int) -> DataFrame:
    """``y``: dry signal and ``taps`` echoes, the k-th of gain feedback**k and k * d samples late.

    ``params`` has ``ms, feedback, mix`` for each key; d is at least a sample. Samples and echoes meet on
    the time they arrive, so work is samples times taps and no signal is held whole.
    """
    rows = with_params(df.select(*keys, "t", "x"), params.select(*keys, "ms", "feedback", "mix"), keys)
    late = F.greatest(F.lit(1), F.rint(F.col("ms") * rate / 1000)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(taps))).alias("_k")).withColumn("_t", (F.col("t") + F.col("_k") * late).cast("int"))
    gain = F.when(F.col("_k") == 0, 1 - F.col("mix")).otherwise(F.col("mix") * F.pow("feedback", F.col("_k")))
    out = rows.groupBy(*keys, F.col("_t").alias("t")).agg(F.sum(gain * F.col("x")).alias("y"), F.max(F.col("_k") == 0).alias("_own"))
    return out.filter("_own").drop("_own")


def mixed_at(signal: DataFrame, noise: DataFrame, snrs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, channel, t, y``: noise added to all channels at ``snr`` dB of each key, then the peak limit.

    Energies are those of the channels' mean. Noise of one channel goes to all of them; it is cut, or
    filled with zeros, to the signal's length. Signals and noise are dealt by key together, once, over as many tasks
    as ``spread`` gives, and all that follows stays there.
    """
    kinds = {f.name: f.dataType for f in signal.schema}
    dry = signal.select(*keys, "channel", "t", "x", F.lit(None).cast("double").alias("_n"), F.lit(True).alias("_dry"))
    wet = noise.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys], F.lit(None).cast(kinds["channel"]).alias("channel"), F.col("t").cast(kinds["t"]).alias("t"), F.lit(None).cast(kinds["x"]).alias("x"), F.col("x").cast("double").alias("_n"), F.lit(False).alias("_dry"))
    place, whole = W.partitionBy(*keys, "t"), W.partitionBy(*keys)
    rows = spread(dry.unionByName(wet), *keys).withColumn("_first", F.row_number().over(place.orderBy(F.desc("_dry"))) == 1)
    rows = rows.withColumns({"_n": F.max("_n").over(place), "_m": F.avg("x").over(place)})
    level = lambda c: 10 * F.log10(F.avg(F.when(F.col("_first"), F.col(c) * F.col(c))).over(whole) + 1e-8)
    both = rows.filter("_dry").fillna(0.0, ["_n"]).withColumn("_d", level("_m") - level("_n")).join(snrs, keys)
    gain = F.sqrt(F.pow(F.lit(10.0), (F.col("_d") - F.col("snr")) / 10))
    mixed = both.select(*keys, "channel", "t", (F.col("x") + gain * F.col("_n")).alias("x"))
    return peak_limited(mixed, [*keys, "channel"]).withColumnRenamed("x", "y")


def shaped(x: Column, drive: Column, mix: Column, normalised: bool) -> Column:
    """Wet and dry of a tanh shaper, wet over tanh(drive) if ``normalised``."""
    wet = F.tanh(drive * x)
    return (1 - mix) * x + mix * (wet / F.tanh(drive) if normalised else wet)


def clipped(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """``y``: a mix of the signal and the signal cut at its quantiles p/2 and 1 - p/2.

    ``params`` has ``p, mix`` for each key. The quantile's share differs by key, so it is interpolated
    between ranks of the sorted samples, gathered once for each key.
    """
    rows = with_params(df, params, keys)
    sorted_ = rows.groupBy(*keys, "p").agg(F.array_sort(F.collect_list("x")).alias("_s"))

    def at(share: Column) -> Column:
        place = share * (F.size("_s") - 1)
        low = F.floor(place).cast("int")
        a, b = F.col("_s")[low], F.col("_s")[F.least(low + 1, F.size("_s") - 1)]
        return a + (b - a) * (place - low)

    cuts = sorted_.select(*keys, at(F.col("p") / 2).alias("_lo"), at(1 - F.col("p") / 2).alias("_hi"))
    wet = F.least(F.greatest("x", "_lo"), F.col("_hi"))
    return rows.join(cuts, keys).withColumn("y", (1 - F.col("mix")) * F.col("x") + F.col("mix") * wet).drop("_lo", "_hi")


def energy_kept(df: DataFrame, keys: list[str], before: str, after: str, fired: str, clamp: float) -> DataFrame:
    """``after`` at the energy of ``before`` where the transform fired, else ``before``; gains lie in [1/clamp, clamp]."""
    if clamp <= 0:
        raise ValueError("clamp must be positive")
    each = W.partitionBy(*keys)
    level = lambda c: F.avg(F.col(c) * F.col(c)).over(each) + 1e-8
    gain = F.least(F.greatest(F.sqrt(level(before) / F.greatest(level(after), F.lit(1e-8))), F.lit(1 / clamp)), F.lit(float(clamp)))
    return df.withColumn(after, F.when(F.col(fired), F.col(after) * gain).otherwise(F.col(before)))


def channels_adapted(rows: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """Signals with ``channels`` channels: as they are, or the mean of their own in each."""
    each = W.partitionBy(*keys)
    counted = rows.withColumn("_n", F.max("channel").over(each) + 1)
    same = counted.filter(F.col("_n") == channels).select(*keys, "channel", "t", "x")
    mean = counted.filter(F.col("_n") != channels).groupBy(*keys, "t").agg(F.avg("x").alias("x"))
    return same.unionByName(mean.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"), "t", "x"))


def fitted(v: Column, length: int) -> Column:
    """An array cut, or filled with zeros, to ``length``."""
    return F.concat(F.slice(v, 1, length), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), length - F.size(v))))


# excerpts and picks


def row_picked(draws: DataFrame, rows: DataFrame, source: str, number: str, seed: int) -> DataFrame:
    """A row of its source for each of ``draws(idx, source)``, uniform and with replacement.

    ``rows`` are numbered from 0 within a source, under ``number``.
    """
    sizes = rows.groupBy(source).agg(F.count("*").alias("_n"))
    chosen = draws.join(sizes, source).withColumn(number, F.floor(uniform(f"{seed}:row", F.col("idx")) * F.col("_n")).cast("long")).drop("_n")
    return chosen.join(rows, [source, number])


def offset_picked(u: Column, file: Column, duration: float, rate: int, most: Column | None = None, from_start: Column | None = None, salient: Column | None = None) -> Column:
    """Offset of an excerpt: 0 from the start or in a short file, else uniform or the salient one, held to the last start.

    ``most`` bounds the offset besides the file's length, for files that go together.
    """
    room = F.greatest(F.lit(0.0), file - duration)
    if most is not None:
        room = F.least(room, most)
    last = F.greatest(F.lit(0.0), room - 1.0 / rate)
    at = u * room if salient is None else F.coalesce(salient, u * room)
    at = F.least(F.greatest(F.lit(0.0), at), last)
    short = F.isnan(file) | file.isNull() | (file <= duration)
    return F.when(short | (F.lit(False) if from_start is None else from_start), 0.0).otherwise(at)


def excerpts(df: DataFrame, starts: DataFrame, keys: list[str], duration: float, rate: int) -> DataFrame:
    """``keys, t, x`` of the samples from int(offset * rate), int(duration * rate) of them or what there is."""
    first, count = (F.col("offset") * rate).cast("long"), int(duration * rate)
    rows = df.join(starts.select(*keys, first.alias("_a")), keys).filter((F.col("t") >= F.col("_a")) & (F.col("t") < F.col("_a") + count))
    return rows.withColumn("t", (F.col("t") - F.col("_a")).cast("int")).drop("_a")


# decoding


def truncated(logits: DataFrame, k: int | None, p: float | None) -> DataFrame:
    """Logits that top-k leaves, and of these top-p; either may be off."""
    rows = logits if k is None else top_k(logits, k)
    return rows if p is None else top_p(rows, p).drop("p")


def sampled(logits: DataFrame, temperature: float, seed: int, argmax: bool = False) -> DataFrame:
    """``pos, cls, p``: a class by inverse CDF at a temperature; the most likely one (the first of equals)
    for ``argmax`` or a temperature of zero or less, with its probability at temperature 1."""
    most = argmax or temperature <= 0
    rows = softmax(logits, 1.0 if most else temperature)
    if most:
        best = F.max_by(F.struct("cls", "p"), F.struct("logit", -F.col("cls"))).alias("b")
        return rows.groupBy("pos").agg(best).select("pos", "b.cls", "b.p")
    order = W.partitionBy("pos").orderBy("cls")
    rows = rows.withColumn("_cum", F.round(F.sum("p").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), 9))
    rows = rows.withColumn("_last", F.lead("cls").over(order).isNull()).filter((F.col("_cum") > uniform(seed, F.col("pos"))) | F.col("_last"))
    return rows.groupBy("pos").agg(F.min_by(F.struct("cls", "p"), "cls").alias("b")).select("pos", "b.cls", "b.p")


def remasked(df: DataFrame, n: Column, temperature: float, causal: float, frames: int, seed: int) -> DataFrame:
    """``keep``: the masked rows of best noisy log-probability, early frames first by ``causal``, until ``n`` remain."""
    noise = temperature * gumbel(uniform(seed, F.col("item"), F.col("frame"))) if temperature else F.lit(0.0)
    score = F.round(F.log(F.greatest(F.col("p"), F.lit(1e-12))) + noise + causal * (1 - (F.col("frame") + 1) / frames), 9)
    rows = df.withColumn("_s", score).withColumn("_m", F.sum(F.col("masked").cast("int")).over(W.partitionBy("item")))
    order = W.partitionBy("item").orderBy(F.desc("masked"), F.desc("_s"), "frame")
    return rows.withColumn("keep", ~F.col("masked") | (F.row_number().over(order) <= F.greatest(F.col("_m") - n, F.lit(0)))).drop("_s", "_m")


# masks and tokens


def seeds(seed: Column, items: Column) -> Column:
    """A seed for each item: an array of that many, or one that counts for all; else an error."""
    fits = F.when(F.size(seed) == items, seed).when(F.size(seed) == 1, F.array_repeat(seed[0], items.cast("int")))
    return F.coalesce(fits, F.raise_error(F.lit("one seed, or one for each item")).cast("array<bigint>"))


def drawn_spans(params: DataFrame, seed: int) -> DataFrame:
    """``item, start, end`` of a random span of each item; ``params`` has ``item, low, high, length``.

    A share of 1 or more spans all of the item's length, one of no length nothing.
    """
    share = F.col("low") + (F.col("high") - F.col("low")) * uniform(f"{seed}:prop", F.col("item"))
    span = F.when(F.col("length") <= 0, 0).when(F.col("_share") >= 1, F.col("length")).otherwise((F.col("_share") * F.col("length")).cast("int"))
    left = F.greatest(F.col("length") - F.col("_span"), F.lit(1))
    start = F.when(F.col("_share") >= 1, 0).otherwise(F.floor(uniform(f"{seed}:start", F.col("item")) * left).cast("int"))
    rows = params.withColumn("_share", share).withColumn("_span", span).withColumn("start", start)
    return rows.select("item", "start", (F.col("start") + F.col("_span")).alias("end"))


def current_codebook(codebook: Column, current: Column) -> Column:
    return codebook == current


def up_to_current(codebook: Column, current: Column) -> Column:
    return codebook <= current


def random_mask(share: float | Column, seed: int, *keys: Column) -> Column:
    """True (keep) with a chance of 1 - ``share``."""
    return uniform(seed, *keys) > share


def masks_broadcast(grid: DataFrame, by_frame: DataFrame, by_codebook: DataFrame) -> DataFrame:
    """``grid(item, codebook, frame, keep)`` and-ed with masks ``(item, frame, keep)`` and ``(item, codebook, keep)``.

    Masks meet cells by item, as an array for each, so that cells partitioned by item do not move. Places count from 0;
    cells without both masks are left out.
    """
    masks = _by_place(by_frame, "frame", "_f").join(_by_place(by_codebook, "codebook", "_c").hint("shuffle_hash"), "item")
    rows = grid.join(masks.hint("shuffle_hash"), "item").withColumn("_f", F.get("_f", F.col("frame"))).withColumn("_c", F.get("_c", F.col("codebook")))
    held = lambda c: F.when(F.col(c) >= 0, F.col(c) == 1)
    return rows.filter("_f is not null and _c is not null").withColumn("keep", F.col("keep") & held("_f") & held("_c")).drop("_f", "_c")


def _by_place(masks: DataFrame, at: str, name: str) -> DataFrame:
    """``item`` and an array by place: 1 where a mask keeps, 0 where it does not, -1 where it is null; null without one."""
    pair = F.struct(F.col(at).alias("at"), F.coalesce(F.col("keep").cast("tinyint"), F.lit(-1).cast("tinyint")).alias("m"))
    rows = masks.filter(F.col(at) >= 0).groupBy("item").agg(F.array_sort(F.collect_list(pair)).alias("_l"))
    last = F.element_at("_l", -1)["at"]
    found = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.get(F.filter("_l", lambda p: p["at"] == i), F.lit(0))["m"])
    return rows.select("item", F.when(last + 1 == F.size("_l"), F.transform("_l", lambda p: p["m"])).otherwise(found).alias(name))


def features_dropped(items: DataFrame, share: float, seed: int) -> DataFrame:
    """``dropped``: whether an item goes without its features, for guidance."""
    return items.withColumn("dropped", uniform(seed, F.col("item")) <= share)


def summed_embeddings(tokens: DataFrame, table: DataFrame, mask_vector: Column, size: int = 1024, width: int = 64) -> DataFrame:
    """``item, frame, v``: vectors of a frame's tokens, summed over codebooks.

    ``tokens(item, codebook, frame, token, keep, current)``; ``table(id, v)`` has token + codebook * size and vectors of
    ``width``. Tokens that are not kept count nothing, but the mask's vector in the codebook that is current. A kept token
    that the table lacks is an error. Sums are made before frames move, a row for each.
    """
    looked = tokens.withColumn("id", F.col("token") + F.col("codebook") * size).join(table.select("id", "v"), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("id").cast("string"))).cast("array<double>")
    cell = F.when(F.col("keep"), F.coalesce("v", missing)).when(F.col("current"), mask_vector).otherwise(F.array_repeat(F.lit(0.0), width))
    sums = [F.sum(F.get("_c", F.lit(i))).alias(f"_{i}") for i in range(width)]
    added = looked.select("item", "frame", cell.alias("_c")).groupBy("item", "frame").agg(*sums)
    return added.select("item", "frame", F.array(*[f"_{i}" for i in range(width)]).alias("v"))


def joined_in_time(first: DataFrame, second: DataFrame, frames: int) -> DataFrame:
    """Token grids one after the other: ``second`` starts at ``frames``."""
    return first.unionByName(second.withColumn("frame", F.col("frame") + frames))


def region(rows: DataFrame, prefix: int) -> DataFrame:
    """Frames from ``prefix`` on, counted from 0."""
    return rows.filter(F.col("frame") >= prefix).withColumn("frame", F.col("frame") - prefix)


def guided_branches(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """``x`` of the guided branch from rows ``branch, keys, x`` of a conditional and an unconditional one."""
    of = lambda b: F.max(F.when(F.col("branch") == b, F.col("x")))
    return rows.groupBy(*keys).agg((of("unconditional") + scale * (of("conditional") - of("unconditional"))).alias("x"))


def factor_products(n: int) -> list[int]:
    """Products of all different multisets of the prime factors of ``n``, itself and 1 included."""
    factors, p, rest = [], 2, n
    while rest > 1:
        while rest % p == 0:
            factors.append(p)
            rest //= p
        p += 1
    return sorted({math.prod(c) for k in range(len(factors) + 1) for c in itertools.combinations(factors, k)})


def loss_total(kl: Column, ce: Column, hard: float) -> Column:
    return (1 - hard) * kl + hard * ce


def rotary(v: Column, pos: Column, base: float = 10000.0) -> Column:
    """An even-sized vector turned by its position: pairs (i, i + half) by pos / base**(i / half)."""
    half = F.floor(F.size(v) / 2).cast("int")

    def turned(x: Column, i: Column) -> Column:
        j = i % half
        angle = pos / F.pow(F.lit(base), j / half)
        other = F.element_at(v, F.when(i < half, i + half + 1).otherwise(j + 1).cast("int"))
        return x * F.cos(angle) + F.when(i < half, -other).otherwise(other) * F.sin(angle)

    return F.transform(v, turned)


# dynamics, filters, responses


def compressor_gains(listen: DataFrame, params: DataFrame, keys: list[str], rate: float, lookahead: int = 0) -> DataFrame:
    """``keys, t, gain`` of a feed-forward compressor that listens to one channel, by parameters of each key.

    ``threshold_db, ratio, attack_ms, release_ms, knee_db, makeup_db``. The level in dB goes through the
    soft-knee curve; its gain is smoothed over the attack time in dB, made up and smoothed over the
    release time in linear scale, of which the smaller counts; the last ``lookahead`` gains are 1.
    """
    p = F.col
    level = 20 * F.log10(F.greatest(F.abs("x"), F.lit(1e-8)))
    over, knee = p("_l") - p("threshold_db"), F.greatest(p("knee_db"), F.lit(0.0))
    bent = p("_l") + (1 / p("ratio") - 1) * F.pow(over + knee / 2, 2) / (2 * knee)
    out = F.when((knee > 0) & (2 * F.abs(over) <= knee), bent).when(2 * over > knee, p("threshold_db") + over / p("ratio")).otherwise(p("_l"))
    pole = lambda ms: params.select(*keys, one_pole_sections(F.exp(F.lit(-math.log(9)) / (F.lit(float(rate)) * p(ms) / 1000))).alias("sections"))
    cut = with_params(listen.select(*keys, "t", level.alias("_l")), params, keys).select(*keys, "t", (out - p("_l")).alias("x"))
    attack = filtered(cut, pole("attack_ms"), keys).join(params.select(*keys, "makeup_db"), keys)
    gains = attack.select(*keys, "t", F.pow(F.lit(10.0), (p("y") + p("makeup_db")) / 20).alias("x"))
    released = filtered(gains, pole("release_ms"), keys)
    return released.select(*keys, (p("t") - lookahead).alias("t"), F.least("x", "y").alias("gain"))


def compressed(df: DataFrame, params: DataFrame, keys: list[str], rate: float, lookahead: int = 0, listen: DataFrame | None = None) -> DataFrame:
    """``y``: signals, of any number of channels, times the gains that ``listen`` gives (``side_chain``, or another signal).

    Without ``listen`` the signal has one channel. Parameters are as in ``compressor_gains``.
    """
    gains = compressor_gains(df if listen is None else listen, params, keys, rate, lookahead)
    return df.join(gains, [*keys, "t"], "left").withColumn("y", F.col("x") * F.coalesce("gain", F.lit(1.0))).drop("gain", "x")


def passed(df: DataFrame, params: DataFrame, keys: list[str], kind: str, zeros: int = 51) -> DataFrame:
    """``keys, t, y``: low or high pass at ``cutoff``, a share of the rate held to [0, 1/2], of each key; ends are held."""
    if kind not in ("low", "high"):
        raise ValueError(f"unknown kind {kind}")
    rows = filters.passed(df, params, keys, zeros)
    return rows.select(*keys, "t", ("y" if kind == "low" else (F.col("x") - F.col("y")).alias("y")))


def equalised(df: DataFrame, params: DataFrame, keys: list[str], rate: float, bands: list[tuple[str, str]]) -> DataFrame:
    """``keys, t, y``: a cascade of second-order sections; ``bands`` are (kind, prefix of its parameters).

    ``params`` has ``{prefix}_db, {prefix}_hz, {prefix}_q`` for each key; frequencies are held to
    [1, 0.999 * rate / 2].
    """
    from .network import biquad

    hz = lambda c: F.least(F.greatest(F.col(c), F.lit(1.0)), F.lit(0.999 * rate / 2))
    flat = lambda s: F.array(*[s[n] for n in ("b0", "b1", "b2", "a1", "a2")])
    sections = F.array(*[flat(biquad(kind, F.col(f"{n}_db"), hz(f"{n}_hz"), F.col(f"{n}_q"), rate)) for kind, n in bands])
    return filtered(df, params.select(*keys, sections.alias("sections")), keys).select(*keys, "t", "y")


def responded(df: DataFrame, responses: DataFrame, keys: list[str], from_peak: bool = True, keep_peak: bool = True) -> DataFrame:
    """``keys, t, y``: the signal in a room, by ``responses(keys, ir)`` of sample arrays.

    The response is cut or filled to the signal's length and turned so that its peak comes first; the
    circular convolution is divided by the response's peak, and brought to the signal's own if ``keep_peak``.
    """
    lengths = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = responses.select(*keys, "ir").join(lengths, keys).select(*keys, F.slice("ir", F.lit(1), F.least(F.col("_n"), F.size("ir").cast("long")).cast("int")).cast("array<double>").alias("ir"))
    cut = cut.withColumn("ir", F.when(F.size("ir") > 0, F.col("ir")).otherwise(F.array(F.lit(0.0))))
    loud = F.transform("ir", lambda v: F.abs(v))
    peak = (F.array_position(loud, F.array_max(loud)) - 1) if from_peak else F.lit(0).cast("long")
    params = cut.select(*keys, F.reverse("ir").alias("ir"), peak.alias("after"), (F.size("ir") - 1 - peak).alias("before"), F.array_max(loud).alias("_h"))
    y = weighted(df, params.drop("_h"), keys, lambda row: row["ir"], ends="ring")
    y = y.join(params.select(*keys, "_h"), keys).withColumn("y", F.col("y") / F.greatest("_h", F.lit(1e-5)))
    if keep_peak:
        top = lambda c: F.greatest(F.max(F.abs(c)), F.lit(1e-8))
        y = y.join(y.groupBy(*keys).agg((top("x") / top("y")).alias("_g")), keys).withColumn("y", F.col("y") * F.col("_g"))
    return y.select(*keys, "t", "y")


def noise_response(params: DataFrame, keys: list[str], rate: float, seed: int) -> DataFrame:
    """``keys, ir``: seeded noise under an attack and a decay, of ceil(duration * rate) samples; wet and dry mixed in.

    ``params`` has ``duration, attack, decay`` in seconds and ``wet`` for each key. The dry part is the first sample.
    """
    t = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") * rate).cast("int") - 1, F.lit(0)))).alias("t")
    rows = params.select("*", t)
    s = F.col("t") / rate
    envelope = F.when(F.col("attack") > 0, F.least(F.lit(1.0), s / F.col("attack"))).otherwise(1.0) * F.exp(-s / F.col("decay"))
    x = F.col("wet") * filters.gaussian(seed, *map(F.col, keys), F.col("t")) * envelope + F.when(F.col("t") == 0, 1 - F.col("wet")).otherwise(0.0)
    return rows.select(*keys, "t", x.alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda e: e["x"]).alias("ir"))
