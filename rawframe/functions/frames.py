"""Rules on a frame's geometry, levels and storage, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .colour import let

# The margin around a mosaic's picture, and the least edge of a useful preview.
MARGIN, USEFUL_EDGE = 2, 1000
# Readers accept black patterns of up to so many rows or columns; samples have 16 bits.
MOST_PATTERN, MOST_SAMPLE, LEAST_STEPS = 8, 65535, 255


def _first(candidates: Column) -> Column:
    return F.get(candidates, F.lit(0))


def _bound(then, **values: Column) -> Column:
    """then(*values), each worked out once however often it is used."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), lambda s: then(*[s[k] for k in values]))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 0 and 0 have 0."""
    pair = lambda x, y: F.struct(x.cast("bigint").alias("a"), y.cast("bigint").alias("b"))

    def found(a: Column, b: Column) -> Column:
        # At most five steps for each digit of the lesser number (Lamé), and one that turns them round.
        steps = F.sequence(F.lit(0), F.length(F.least(a, b).cast("string")) * 5)
        return F.aggregate(F.when(a.isNotNull() & b.isNotNull(), steps), pair(a, b), lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.nullif(s["b"], F.lit(0)))))["a"]

    return _bound(found, a=F.abs(a).cast("bigint"), b=F.abs(b).cast("bigint"))


def lcm(a: Column, b: Column) -> Column:
    found = lambda a, b: F.when((a == 0) | (b == 0), 0).otherwise(F.floor(F.abs(a) / F.greatest(gcd(a, b), F.lit(1))) * F.abs(b)).cast("bigint")
    return _bound(found, a=a, b=b)


def even_size(n: Column) -> Column:
    return n + n % 2


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def frame_line(stored: Column, field: Column, factor: Column) -> Column:
    """Which line of a frame is stored at a place, where all fields are `field` lines."""
    return ((stored % field) * factor + F.floor(stored / field)).cast("bigint")


def whole_stored_line(line: Column, field: Column, factor: Column) -> Column:
    """The inverse: where a line is stored."""
    return ((line % factor) * field + F.floor(line / factor)).cast("bigint")


def pixel_scale(aspect: Column) -> Column:
    """struct(h, v): how pixels that aren't square are shown; never less than 1."""
    odd = (aspect > 0) & (F.abs(aspect - 1.0) > 1e-3)
    return F.struct(F.when(odd & (aspect > 1), aspect).otherwise(1.0).alias("h"), F.when(odd & (aspect <= 1), F.lit(1.0) / F.nullif(aspect, F.lit(0.0))).otherwise(1.0).alias("v"))


def default_crop(width: Column, height: Column, left: Column, top: Column, inset: dict[str, Column], is_cfa: Column) -> Column:
    """struct(left, top, width, height) in the active area, which lies at (left, top) of the frame.

    The camera's inset (width, height, left, top in the frame; 65535: centred) where it fits; a
    mosaic keeps a margin of two pixels if it is large enough for one."""
    fits = (inset["width"] > 0) & (inset["height"] > 0) & (inset["width"] <= width) & (inset["height"] <= height)

    def axis(size: Column, origin: Column, extent: Column, at: Column) -> tuple[Column, Column]:
        start = F.when(at == 65535, F.floor((size - extent) / 2)).otherwise(at - origin)
        first = F.when(fits, clamp(start, F.lit(0), size - extent)).otherwise(0)
        return first, first + F.when(fits, extent).otherwise(size)

    x0, x1 = axis(width, left, inset["width"], inset["left"])
    y0, y1 = axis(height, top, inset["height"], inset["top"])
    mx0, mx1 = F.greatest(x0, F.lit(MARGIN)), F.least(x1, width - MARGIN)
    my0, my1 = F.greatest(y0, F.lit(MARGIN)), F.least(y1, height - MARGIN)
    held = is_cfa & (width > 16 * MARGIN) & (height > 16 * MARGIN) & (mx1 > mx0) & (my1 > my0)
    pick = lambda a, b, name: F.when(held, a).otherwise(b).cast("bigint").alias(name)
    return F.struct(pick(mx0, x0, "left"), pick(my0, y0, "top"), pick(mx1 - mx0, x1 - x0, "width"), pick(my1 - my0, y1 - y0, "height"))


def white_level(camera: Column, format_max: Column, max_black: Column) -> Column:
    """The camera's own saturation if it lies between black and the format's; 65535 if that isn't above black."""
    most = F.when(format_max > 0, format_max).otherwise(MOST_SAMPLE)
    white = F.when((camera > max_black) & (camera < most), camera).otherwise(most)
    return F.least(F.when(white <= max_black, MOST_SAMPLE).otherwise(white), F.lit(MOST_SAMPLE)).cast("double")


def common_levels(white: Column, black: Column) -> Column:
    """struct(white, black, range): what all planes share, the range at least 1."""
    w, b = F.array_min(white), F.array_max(black)
    return F.struct(w.alias("white"), b.alias("black"), F.greatest(F.lit(1.0), w - b).alias("range"))


def black_pattern(base: Column, by_colour: Column, cfa: Column, rows: Column, cols: Column, pattern: Column, pattern_rows: Column, pattern_cols: Column) -> Column:
    """struct(rows, cols, levels, simplified) of a mosaic's black levels.

    The colours' and the pattern's periods are brought together; beyond eight the colours' alone
    stay. A pattern of one value is one level."""
    def periods(base, by_colour, cfa, rows, cols, pattern, pattern_rows, pattern_cols):
        has = (pattern_rows > 0) & (pattern_cols > 0)
        long = lambda a, b: F.when(has, lcm(a, F.greatest(b, F.lit(1)))).otherwise(a)

        def sizes(long_rows, long_cols):
            simplified = (long_rows > MOST_PATTERN) | (long_cols > MOST_PATTERN)
            return _bound(made, n_rows=F.when(simplified, rows).otherwise(long_rows), n_cols=F.when(simplified, cols).otherwise(long_cols), simplified=simplified)

        def made(n_rows, n_cols, simplified):
            def level(r, c):
                colour = F.get(cfa, ((r % rows) * cols + c % cols).cast("int"))
                own = F.coalesce(F.get(pattern, ((r % F.nullif(pattern_rows, F.lit(0))) * pattern_cols + c % F.nullif(pattern_cols, F.lit(0))).cast("int")), F.lit(0.0))
                return (base + F.get(by_colour, colour.cast("int")) + F.when(has, own).otherwise(0.0)).cast("double")

            each = lambda i: _bound(level, r=F.floor(i / n_cols).cast("int"), c=(i % n_cols).cast("int"))
            levels = F.transform(F.sequence(F.lit(0).cast("bigint"), (n_rows * n_cols - 1).cast("bigint")), each)
            return _bound(lambda levels, n_rows, n_cols, simplified: flattened(levels, n_rows, n_cols, simplified), levels=levels, n_rows=n_rows, n_cols=n_cols, simplified=simplified)

        def flattened(levels, n_rows, n_cols, simplified):
            flat = F.array_min(levels) == F.array_max(levels)
            one = lambda a, b: F.when(flat, a).otherwise(b)
            return F.struct(one(F.lit(1), n_rows).cast("bigint").alias("rows"), one(F.lit(1), n_cols).cast("bigint").alias("cols"), one(F.slice(levels, 1, 1), levels).alias("levels"), simplified.alias("simplified"))

        return _bound(sizes, long_rows=long(rows, pattern_rows), long_cols=long(cols, pattern_cols))

    return _bound(periods, base=base, by_colour=by_colour, cfa=cfa, rows=rows, cols=cols, pattern=pattern, pattern_rows=pattern_rows, pattern_cols=pattern_cols)


def cfa_rows(colours: Column) -> Column:
    """The rows after which a pattern of eight rows and two columns repeats: 2, 4 or 8."""

    def found(c: Column) -> Column:
        def repeats(n: int) -> Column:
            out = F.lit(True)
            for i in range(2 * n, 16):
                out = out & (F.get(c, F.lit(i)) == F.get(c, F.lit(i % (2 * n))))
            return out

        return F.when(repeats(2), 2).when(repeats(4), 4).otherwise(8)

    return let(colours, found)


def filter_pattern(colours: Column, letters: Column, number: Column, sixteen: Column) -> Column:
    """struct(rows, cols, pattern, plane_colours, reason) of a colour filter array.

    colours: indices of the decoder's colours, of eight rows of two columns, or of six by six. letters: the four colours' letters;
    number: how many colours there are. With three, the fourth index is a second one of the plane with its letter, or else of the
    second plane. The rows are the least of 2, 4 and 8 after which the pattern repeats; sixteen by sixteen isn't supported."""
    # The numbers of colours, and the reasons' texts.
    codes = F.create_map(*[v for k, letter in enumerate("RGBCMYW") for v in (F.lit(letter), F.lit(k))])

    def found(colours, letters, number, sixteen):
        letter = lambda i: F.substring(letters, i + 1, 1)
        same = F.when(letter(2) == letter(3), 2).when(letter(1) == letter(3), 1).when(letter(0) == letter(3), 0).otherwise(1)
        used = F.transform(F.sequence(F.lit(0), number.cast("int") - 1), lambda p: F.substring(letters, p + 1, F.lit(1)))
        six = F.size(colours) == 36
        return _bound(sized, colours=colours, number=number, sixteen=sixteen, same=same, used=used, rows=F.when(six, 6).otherwise(cfa_rows(colours)), cols=F.when(six, 6).otherwise(2))

    def sized(colours, number, sixteen, same, used, rows, cols):
        own = F.slice(colours, F.lit(1), rows * cols)
        unknown = F.get(F.filter(used, lambda c: ~F.map_contains_key(codes, c)), F.lit(0))
        reason = (
            F.when(sixteen, "16x16 colour filter patterns are not supported yet")
            .when(~number.isin(3, 4), "unexpected number of colours in the filter array")
            .when(unknown.isNotNull(), F.concat(F.lit("colour filter '"), unknown, F.lit("' has no DNG equivalent")))
            .when(~F.forall(own, lambda i: i.between(0, 3)), "unreadable colour filter layout")
        )
        return _bound(judged, own=own, number=number, same=same, used=used, rows=rows, cols=cols, reason=reason)

    def judged(own, number, same, used, rows, cols, reason):
        sound = reason.isNull()
        pattern = F.transform(own, lambda i: F.when((i == 3) & (number == 3), same).otherwise(i))
        return F.struct(F.when(sound, rows).alias("rows"), F.when(sound, cols).alias("cols"), F.when(sound, pattern).alias("pattern"), F.when(sound, F.transform(used, lambda c: F.try_element_at(codes, c))).alias("plane_colours"), reason.alias("reason"))

    return _bound(found, colours=colours, letters=letters, number=number, sixteen=sixteen)


def mosaic_block(cfa: Column, rows: int, cols: int, planes: int) -> Column:
    """struct(height, width): the smallest part of a pattern whose repetitions all hold each colour equally often."""
    at = lambda y, x: F.get(cfa, F.lit(y * cols + x))
    out = None
    sizes = [(h, w) for h in range(1, rows + 1) if rows % h == 0 for w in range(1, cols + 1) if cols % w == 0 and h * w < rows * cols]
    for h, w in sorted(sizes, key=lambda s: (s[0] * s[1], s[0])):
        blocks = [F.array_sort(F.array(*[at(y + dy, x + dx) for dy in range(h) for dx in range(w)])) for y in range(0, rows, h) for x in range(0, cols, w)]
        balanced = F.lit(True)
        for b in blocks[1:]:
            balanced = balanced & (b == blocks[0])
        for p in range(min(planes, 4)):
            balanced = balanced & F.array_contains(blocks[0], p)
        size = F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"))
        out = F.when(balanced, size) if out is None else out.when(balanced, size)
    whole = F.struct(F.lit(rows).alias("height"), F.lit(cols).alias("width"))
    return whole if out is None else out.otherwise(whole)


def render_size(width: Column, height: Column, skip_x: Column, skip_y: Column, period_x: Column, period_y: Column, scale_h: Column, scale_v: Column, most: Column) -> Column:
    """struct(width, height) of a rendering of a crop, null where none is possible. skip: how far the crop begins
    behind the mosaic's grid. Whole cells only, never enlarged, at most `most` on the longer edge (0: any)."""
    lost = lambda skip, period: (period - skip % period) % period
    w, h = width - lost(skip_x, period_x), height - lost(skip_y, period_y)
    cells_x, cells_y = F.floor(w / period_x), F.floor(h / period_y)
    shown_w, shown_h = w * scale_h, h * scale_v
    shrink = F.least(F.lit(1.0), cells_x / shown_w, cells_y / shown_h, F.when(most > 0, most / F.greatest(shown_w, shown_h)).otherwise(1.0))
    side = lambda shown, cells: clamp(F.floor(shown * shrink + 0.5), F.lit(1), cells).cast("bigint")
    good = (width > 0) & (height > 0) & (w >= period_x) & (h >= period_y) & (scale_h > 0) & (scale_v > 0)
    return F.when(good, F.struct(side(shown_w, cells_x).alias("width"), side(shown_h, cells_y).alias("height")))


def render_layout(left: Column, top: Column, width: Column, height: Column, skip_x: Column, skip_y: Column, period_x: Column, period_y: Column, scale_h: Column, scale_v: Column, most: Column) -> Column:
    """struct(width, height, cell_width, cell_height, across, down, left, top) of a rendering of a crop, null where none is possible.

    Cells are whole parts of the mosaic, the largest that still give the size of render_size; there are across x down of them,
    of which the rendering is averaged. What is left over goes off both edges alike, by whole parts."""
    size = render_size(width, height, skip_x, skip_y, period_x, period_y, scale_h, scale_v, most)
    lost = lambda skip, period: (period - skip % period) % period

    def axis(start: Column, extent: Column, skip: Column, period: Column, shown: Column) -> tuple[Column, Column, Column]:
        whole = extent - lost(skip, period)
        cell = period * F.floor(F.floor(whole / period) / F.nullif(shown, F.lit(0)))
        count = F.floor(whole / F.nullif(cell, F.lit(0)))
        begin = start + lost(skip, period) + F.floor(F.floor((whole - count * cell) / 2) / period) * period
        return cell.cast("bigint"), count.cast("bigint"), begin.cast("bigint")

    def made(found: Column) -> Column:
        x, y = axis(left, width, skip_x, period_x, found["width"]), axis(top, height, skip_y, period_y, found["height"])
        parts = {"width": found["width"], "height": found["height"], "cell_width": x[0], "cell_height": y[0], "across": x[1], "down": y[1], "left": x[2], "top": y[2]}
        return F.when(found.isNotNull(), F.struct(*[v.alias(n) for n, v in parts.items()]))

    return let(size, made)


def preview_choice(mode: Column, camera: Column, rendered: Column) -> Column:
    """struct(kind, width, height) from structs of sizes (null: there is none). mode: auto, camera, render or none.

    By itself the camera's picture is taken unless it is a thumbnail and a rendering is larger."""
    edge = lambda s: F.greatest(s["width"], s["height"])
    has, can = camera.isNotNull() & mode.isin("auto", "camera"), rendered.isNotNull() & mode.isin("auto", "render")
    own = has & (~can | (edge(camera) >= USEFUL_EDGE) | (edge(camera) >= edge(rendered)))
    made = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s["width"].cast("bigint").alias("width"), s["height"].cast("bigint").alias("height"))
    return F.when(own, made("camera", camera)).when(can, made("rendered", rendered))


def lossy_refusal(spp: Column, width: Column, height: Column, rows: Column, cols: Column) -> Column:
    """Why a frame can't be stored lossily, or null."""
    # The reasons' texts.
    return F.when(spp != 1, "full-colour raw data (several samples per pixel)").when((width < cols * 2) | (height < rows * 2), "an active area too small for its colour pattern")


def storage_choice(compression: Column, distance: Column, spp: Column, refusal: Column) -> Column:
    """struct(compression, distance, notes): jxl only for one or three samples a pixel, lossy only without a refusal."""
    falls_back = (compression == "jxl") & ~spp.isin(1, 3)
    chosen = F.when(falls_back, "lossless jpeg").otherwise(compression)
    plain = (chosen == "jxl") & (distance > 0) & refusal.isNotNull()
    # The notes' texts.
    notes = F.concat_ws(
        "; ",
        F.when(falls_back, F.concat(spp.cast("string"), F.lit(" samples per pixel cannot be stored with JPEG XL; lossless JPEG was used"))),
        F.when(plain, F.concat(F.lit("lossy JPEG XL cannot store "), refusal, F.lit("; stored losslessly"))),
    )
    return F.struct(chosen.alias("compression"), F.when(plain, 0.0).otherwise(distance).alias("distance"), notes.alias("notes"))


def option_rules(distance: Column, effort: Column, jobs: Column, preview: Column) -> list[tuple[str, Column]]:
    """What options must keep to; preview 0 stands for the greatest size."""
    # The ranges of the options.
    return [
        ("distance", ~((distance == 0) | distance.between(0.05, 25))),
        ("effort", ~effort.between(1, 9)),
        ("jobs", ~jobs.between(1, 1024)),
        ("preview size", ~((preview == 0) | preview.between(64, 65535))),
    ]


def neutral(camera: Column, daylight: Column, planes: Column) -> Column:
    """struct(neutral, source): least multiplier over each, from the camera's multipliers or else from daylight's."""
    usable = lambda m: F.forall(F.slice(m, F.lit(1), planes), lambda x: (x > 0) & (x < float("inf"))) & (F.size(m) >= planes)

    def of(m: Column, source: str) -> Column:
        own = F.slice(m, F.lit(1), planes)
        return F.struct(F.transform(own, lambda x: F.array_min(own) / x).alias("neutral"), F.lit(source).alias("source"))

    return F.when(usable(camera), of(camera, "as shot")).when(usable(daylight), of(daylight, "daylight"))


def matrix_source(known: Column, planes: Column, invertible: Column) -> Column:
    """Where a colour matrix comes from: the camera's own if any entry of its first three rows isn't 0, one derived, or sRGB's."""
    own = F.exists(F.slice(known, 1, 9), lambda x: x != 0)
    return F.when(planes < 3, None).when(own, "known").when((planes == 3) & invertible, "derived").otherwise("srgb")


def maker_settings(distortion: Column, aberration: Column, vignetting: Column) -> Column:
    """struct of what a maker's settings say: known and enabled corrections, and whether the data has the gain already."""
    # 0 off, 255 (511 for vignetting) unknown, 256 data without the gain.
    return F.struct(
        (distortion != 255).alias("distortion_known"),
        ((distortion != 255) & (distortion != 0)).alias("distortion"),
        (aberration != 255).alias("aberration_known"),
        ((aberration != 255) & (aberration != 0)).alias("aberration"),
        (vignetting != 511).alias("vignetting_known"),
        ((vignetting != 511) & (vignetting != 256)).alias("vignetting_in_data"),
    )


def swapped(data: Column, size: Column) -> Column:
    """Bytes of elements of `size` bytes in the other order; rationals go by halves of four. What is left of a last part stays."""
    turned = lambda e: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.floor(F.length(e) / 2).cast("int") - 1), lambda i: F.substring(e, i * 2 + 1, F.lit(2)))), "")

    def found(h: Column, size: Column, whole: Column) -> Column:
        element = lambda k: F.substring(h, (k * size * 2 + 1).cast("int"), (size * 2).cast("int"))
        parts = F.when(whole > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), whole - 1), lambda k: let(element(k), turned))).otherwise(F.array().cast("array<string>"))
        rest = F.substring(h, (whole * size * 2 + 1).cast("int"), F.length(h))
        return F.unhex(F.concat(F.array_join(parts, ""), rest))

    return _bound(lambda h, size: _bound(found, h=h, size=size, whole=F.floor(F.length(h) / 2 / size)), h=F.hex(data), size=size)


def bad_pixels_opcode(constant: Column, phase: Column) -> Column:
    """The opcode list of one instruction that mends all samples equal to the constant; big-endian."""
    word = lambda v: F.lpad(F.hex(v.cast("bigint")), 8, "0")
    # One instruction, its number, version 1.3, optional, eight bytes of parameters.
    return F.unhex(F.concat(*[word(F.lit(x)) for x in (1, 4, 0x01030000, 1, 8)], word(constant), word(phase)))


def written_phase(phase: Column) -> Column:
    """The Bayer phase that readers of the bad-pixel instruction take for this one."""
    return F.when(phase >= 0, phase.bitwiseXOR(F.lit(1)))


def serial(text: Column) -> Column:
    """A serial number, or nothing where it has no letter or digit."""
    return F.when(text.rlike("[A-Za-z0-9]"), text).otherwise("")


def joined_notes(*notes: Column) -> Column:
    """The notes that are there, with commas."""
    return F.concat_ws(", ", *[F.nullif(n, F.lit("")) for n in notes])


def error_text(rms: Column, tile_rms: Column, p999: Column) -> Column:
    # Fixed value: the text.
    return F.format_string("rms %.3f %%, worst tile %.3f %%, 99.9 %% within %.2f %%", rms * 100, tile_rms * 100, p999 * 100)


def illuminant(code: Column) -> Column:
    # Names of light sources by their numbers.
    names = {1: "daylight", 2: "fluorescent", 3: "tungsten", 4: "flash", 17: "A", 18: "B", 19: "C", 20: "D55", 21: "D65", 22: "D75", 23: "D50", 24: "studio tungsten"}
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.concat(F.lit("light source "), code.cast("string")))


def profile_label(name: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(file_name, F.lit("")), F.lit("unnamed profile"))


def profile_summary(illuminants: Column, forward: Column, hue_dims: Column, look_dims: Column, tone_curve: Column, number: Column | None = None) -> Column:
    """A line on a profile from its light sources (array of codes; number: how many it is made for, if not these), table dimensions (arrays or null) and flags."""
    n = F.size(illuminants) if number is None else number
    # The words of the summary.
    counted = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("no", "one", "two", "three")]), (F.least(n, F.lit(3)) + 1).cast("int")), F.lit(" illuminant"), F.when(n == 1, "").otherwise("s"))
    lights = F.array_join(F.transform(illuminants, illuminant), ", ")
    table = lambda what, dims: F.when(dims.isNotNull(), F.concat(F.lit(what), F.lit(" "), F.array_join(F.transform(dims, lambda d: d.cast("string")), "x")))
    return F.concat_ws(", ", F.concat(counted, F.when(F.size(illuminants) > 0, F.concat(F.lit(" ("), lights, F.lit(")"))).otherwise("")), F.when(forward, "forward matrix"), table("hue and saturation table", hue_dims), table("look table", look_dims), F.when(tone_curve, "tone curve"))


def addable_digest(version: Column, compressed: Column, damaged: Column, mask: Column, has_any: Column) -> Column:
    """Which digest a sound file without one gets: new (from version 1.4, and for compressed data), old, or none."""
    return F.when(damaged | mask | has_any, None).when(compressed | (version >= 0x0104), "new").otherwise("old")


def verdict_text(truncated: Column, raw: Column, raw_detail: Column, original: Column, original_detail: Column) -> Column:
    """struct(outcome, text) of a check. A file that is cut short is reported as that alone."""
    # The words of the verdicts.
    damage = F.coalesce(truncated, F.concat_ws("; ", F.when(raw == "damaged", raw_detail), F.when(original == "damaged", original_detail)))
    bad = truncated.isNotNull() | (raw == "damaged") | (original == "damaged")
    intact = (raw == "intact") & original.isin("intact", "absent")
    left = F.concat_ws(
        "; ",
        F.when(raw == "intact", "raw image intact").otherwise(raw_detail),
        F.when(original == "intact", "embedded original intact").when(original == "unverified", F.concat(F.lit("embedded original "), original_detail)),
    )
    outcome = F.when(bad, "damaged").when(intact, "intact").otherwise("unverified")
    said = (
        F.when(bad, F.concat(F.lit("DAMAGED: "), damage))
        .when(intact, F.concat(F.lit("intact (raw image"), F.when(original == "intact", ", embedded original").otherwise(""), F.lit(")")))
        .otherwise(F.concat(F.lit("not verified: "), left))
    )
    return F.struct(outcome.alias("outcome"), said.alias("text"))


def layout_reasons(bits: Column, planes: Column, planar: Column, sample_format: Column, fill_order: Column, compression: Column, row_factor: Column, column_factor: Column, width: Column, height: Column) -> Column:
    """struct(unsupported, damage): why a raw image can't be checked although nothing is wrong with it, and what is wrong."""
    # The numbers of compressions and the reasons' texts.
    unsupported = (
        F.when(sample_format != 1, "floating-point raw data")
        .when(~bits.between(8, 16), F.concat(bits.cast("string"), F.lit(" bits per sample")))
        .when((planes > 1) & (planar != 1), "colour planes stored separately")
        .when(fill_order != 1, "reversed bit order")
        .when(compression.isin(8, 32946), "Deflate compression")
        .when(compression == 34892, "lossy JPEG compression")
        .when(~compression.isin(1, 7, 52546), F.concat(F.lit("compression type "), compression.cast("string")))
    )
    damage = (
        F.when((width <= 0) | (height <= 0), "the raw image has no size")
        .when(~planes.between(1, 8), "the raw image has an impossible number of colour planes")
        .when((compression == 52546) & ~planes.isin(1, 3), "JPEG XL data with other than one or three colour planes")
        .when((row_factor <= 0) | (column_factor <= 0) | (row_factor > height) | (column_factor > width), "the raw image has an impossible interleave factor")
    )
    return F.struct(F.when(damage.isNull(), unsupported).alias("unsupported"), damage.alias("damage"))
