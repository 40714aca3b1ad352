"""Column expressions for image assets: routing by type, data URIs and the image token estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the vision-token estimate: patch side, token floor and caps (patches).
PATCH = 28
MIN_PATCHES = 4
MAX_PATCHES = 1280
MAX_PATCHES_HIGH_RES = 16384


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def media_route(name) -> tuple[Column, Column]:
    """``(kind, mime)`` by file name: ``.gif`` -> frames, ``.png`` / ``.jpeg`` / ``.jpg`` /
    ``.webp`` -> image with its MIME type, anything else -> reject.  Case-sensitive suffixes."""
    n = _c(name)
    mime = (F.when(n.endswith(".png"), F.lit("image/png"))
            .when(n.endswith(".jpeg") | n.endswith(".jpg"), F.lit("image/jpeg"))
            .when(n.endswith(".webp"), F.lit("image/webp")))
    kind = (F.when(n.endswith(".gif"), F.lit("frames"))
            .when(mime.isNotNull(), F.lit("image"))
            .otherwise(F.lit("reject")))
    return kind, F.when(n.endswith(".gif"), F.lit("image/png")).otherwise(mime)


def data_uri(mime, payload) -> Column:
    """``data:<mime>;base64,<base64 of payload>`` (one line: MIME line breaks removed)."""
    return F.concat(F.lit("data:"), _c(mime), F.lit(";base64,"), F.regexp_replace(F.base64(_c(payload)), "[\r\n]", ""))


def snapped_size(height, width, high_res: bool = False) -> tuple[Column, Column]:
    """Image size snapped to multiples of 28 (half-even rounding); areas above the cap are
    scaled down (floor) and areas under 4 patches scaled up (ceil).  Missing sizes give 0 x 0."""
    h = _c(height).cast("double")
    w = _c(width).cast("double")
    f = float(PATCH)
    max_px = (MAX_PATCHES_HIGH_RES if high_res else MAX_PATCHES) * PATCH * PATCH
    min_px = MIN_PATCHES * PATCH * PATCH
    h0 = F.bround(h / f, 0) * f
    w0 = F.bround(w / f, 0) * f
    down = F.sqrt(h * w / F.lit(float(max_px)))
    up = F.sqrt(F.lit(float(min_px)) / (h * w))
    hb = (F.when(h0 * w0 > max_px, F.floor(h / down / f) * f)
          .when(h0 * w0 < min_px, F.ceil(h * up / f) * f)
          .otherwise(h0))
    wb = (F.when(h0 * w0 > max_px, F.floor(w / down / f) * f)
          .when(h0 * w0 < min_px, F.ceil(w * up / f) * f)
          .otherwise(w0))
    missing = _c(height).isNull() | _c(width).isNull() | (_c(height) <= 0) | (_c(width) <= 0)
    return (F.when(missing, F.lit(0)).otherwise(hb.cast("long")),
            F.when(missing, F.lit(0)).otherwise(wb.cast("long")))


def image_tokens(height, width, high_res: bool = False) -> Column:
    """Vision tokens of one image: snapped area / 28^2, truncated."""
    hb, wb = snapped_size(height, width, high_res)
    return F.floor(hb * wb / F.lit(PATCH * PATCH)).cast("long")
