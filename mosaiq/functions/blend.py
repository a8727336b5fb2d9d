"""Blend modes (B0 to B36) as chains of column expressions.

Rows have a source pixel sr, sg, sb, sa and a destination dr, dg, db, da in
bytes, a mask byte and an opacity from 0 to 256; the result is r, g, b, a.
Modes with byte arithmetic stay in integers, the others in doubles that are
rounded back to bytes.
"""

from __future__ import annotations

from mosaiq.plans.recipe import Recipe

# Composite codes and the names of their modes.
MODES = {
    0: "normal", 1: "darken", 2: "multiply", 3: "color_burn", 4: "linear_burn", 5: "subtract", 6: "darker_color", 7: "lighten", 8: "screen",
    9: "color_dodge", 10: "glow_dodge", 11: "add", 12: "add_glow", 13: "lighter_color", 14: "overlay", 15: "soft_light", 16: "hard_light",
    17: "vivid_light", 18: "linear_light", 19: "pin_light", 20: "hard_mix", 21: "difference", 22: "exclusion", 23: "hue", 24: "saturation",
    25: "color", 26: "brightness", 36: "divide",
}
# Luminance weights; the modes differ in them on purpose.
GENERAL, REC601, FINE, REC709 = (0.3, 0.6, 0.1), (0.299, 0.587, 0.114), (0.3, 0.59, 0.11), (0.2126, 0.7152, 0.0722)
BYTE_MODES = (0, 3, 9, 10, 12)
RGB = "rgb"

VIVID = (
    "CASE WHEN {s} < 0.5 THEN CASE WHEN {d} >= 1.0 THEN 1.0 WHEN {s} <= 0.0 THEN 0.0 ELSE 1.0 - least((1.0 - {d}) / greatest(2.0 * {s}, 0.000001), 1.0) END "
    "WHEN {d} <= 0.0 THEN 0.0 WHEN 2.0 * ({s} - 0.5) >= 1.0 THEN 1.0 ELSE least({d} / greatest(1.0 - 2.0 * ({s} - 0.5), 0.000001), 1.0) END"
)
SEPARABLE = {
    1: "least({s}, {d})",
    2: "{s} * {d}",
    4: "greatest({s} + {d} - 1.0, 0.0)",
    5: "greatest({d} - {s}, 0.0)",
    7: "greatest({s}, {d})",
    8: "1.0 - (1.0 - {s}) * (1.0 - {d})",
    11: "least({s} + {d}, 1.0)",
    14: "CASE WHEN {d} < 0.5 THEN 2.0 * {s} * {d} ELSE 1.0 - 2.0 * (1.0 - {s}) * (1.0 - {d}) END",
    15: "CASE WHEN {s} < 0.5 THEN {d} - (1.0 - 2.0 * {s}) * {d} * (1.0 - {d}) ELSE {d} + (2.0 * {s} - 1.0) * (CASE WHEN {d} < 0.25 THEN ((16.0 * {d} - 12.0) * {d} + 4.0) * {d} ELSE sqrt({d}) END - {d}) END",
    16: "CASE WHEN {s} < 0.5 THEN 2.0 * {s} * {d} ELSE 1.0 - 2.0 * (1.0 - {s}) * (1.0 - {d}) END",
    17: VIVID,
    18: "2.0 * {s} + {d} - 1.0",
    19: "CASE WHEN {s} < 0.5 THEN least({d}, 2.0 * {s}) ELSE greatest({d}, 2.0 * ({s} - 0.5)) END",
    20: f"CASE WHEN {VIVID} >= 127.0 / 255.0 THEN 1.0 ELSE 0.0 END",
    21: "abs({s} - {d})",
    22: "{s} + {d} - 2.0 * {s} * {d}",
    36: "least({d} / greatest({s}, 0.000001), 1.0)",
}


def byte(x: str) -> str:
    """A unit value as the nearest byte."""
    return f"CAST(floor(least(greatest({x}, 0.0), 1.0) * 255.0 + 0.5) AS BIGINT)"



def _luma(prefix: str, weights: tuple[float, float, float]) -> str:
    return " + ".join(f"{w} * {prefix}{c}" for w, c in zip(weights, RGB, strict=True))


def _set_lum(out: Recipe, of: str, target: str, weights: tuple[float, float, float], to: str) -> None:
    """of's channels shifted to the luminance target and scaled back into range about it."""
    out.add(**{f"{to}_l0": _luma(of, weights)})
    out.add(**{f"{to}_n{c}": f"{of}{c} + ({target} - {to}_l0)" for c in RGB})
    n = ", ".join(f"{to}_n{c}" for c in RGB)
    out.add(**{f"{to}_l": _luma(f"{to}_n", weights), f"{to}_lo": f"least({n})", f"{to}_hi": f"greatest({n})"})
    out.add(**{f"{to}_m{c}": f"CASE WHEN {to}_lo < 0.0 THEN {to}_l + ({to}_n{c} - {to}_l) * {to}_l / greatest({to}_l - {to}_lo, 0.000001) ELSE {to}_n{c} END" for c in RGB})
    out.add(**{f"{to}_{c}": f"CASE WHEN {to}_hi > 1.0 THEN {to}_l + ({to}_m{c} - {to}_l) * (1.0 - {to}_l) / greatest({to}_hi - {to}_l, 0.000001) ELSE {to}_m{c} END" for c in RGB})


def _set_sat(out: Recipe, of: str, target: str, to: str) -> None:
    """of's channels stretched from nothing to the saturation target."""
    cs = ", ".join(f"{of}{c}" for c in RGB)
    out.add(**{f"{to}_lo": f"least({cs})", f"{to}_span": f"greatest({cs}) - least({cs})"})
    out.add(**{f"{to}_e{c}": f"({of}{c} - {to}_lo) / greatest({to}_span, 0.000001)" for c in RGB})
    out.add(**{f"{to}_{c}": f"CASE WHEN {to}_span <= 0.0 THEN 0.0 WHEN {to}_span <= 2.0 / 255.0 THEN floor({to}_e{c} + 0.000001) * {target} ELSE {to}_e{c} * {target} END" for c in RGB})


def _ceil_min(out: Recipe, of: str, when: str, to: str) -> None:
    """Where when holds, channels at the minimum go up to the next byte."""
    cs = ", ".join(f"{of}{c}" for c in RGB)
    out.add(**{f"{to}{c}": f"CASE WHEN ({when}) AND {of}{c} <= least({cs}) + 0.000001 THEN ceil({of}{c} * 255.0 - 0.000001) / 255.0 ELSE {of}{c} END" for c in RGB})


def _mixed(out: Recipe, mode: int) -> None:
    """The modes that mix channels: raw_r, raw_g, raw_b."""
    sat = lambda p: f"greatest({p}r, {p}g, {p}b) - least({p}r, {p}g, {p}b)"
    if mode in (6, 13):
        wins = f"{_luma('s_', REC709)} {'<' if mode == 6 else '>'} {_luma('d_', REC709)}"
        out.add(**{f"raw_{c}": f"CASE WHEN {wins} THEN s_{c} ELSE d_{c} END" for c in RGB})
    elif mode == 23:
        out.add(dsat=sat("d_"))
        _set_sat(out, "s_", "dsat", "hs")
        for tag, w in (("h1", FINE), ("h2", GENERAL)):
            out.add(**{f"{tag}_t": _luma("d_", w)})
            _set_lum(out, "hs_", f"{tag}_t", w, tag)
        out.add(**{f"hx_{c}": f"CASE WHEN sa_f >= 1.0 THEN h1_{c} ELSE h2_{c} END" for c in RGB})
        _ceil_min(out, "hx_", "dsat > 2.0 / 255.0", "raw_")
    elif mode == 24:
        out.add(ssat=sat("s_"), dlum=_luma("d_", GENERAL))
        _set_sat(out, "d_", "ssat", "ts")
        _set_lum(out, "ts_", "dlum", GENERAL, "tl")
        _ceil_min(out, "tl_", f"{sat('d_')} > 4.0 / 255.0 AND tl_hi > 1.0", "raw_")
    elif mode == 25:
        out.add(dlum=_luma("d_", GENERAL))
        _set_lum(out, "s_", "dlum", GENERAL, "c1")
        rounded = lambda p: f"floor(({_luma(p, FINE)}) * 255.0 + 0.5) / 255.0"
        # the other luminance, rounded to bytes, where the shift would go below nothing
        out.add(c2_shift=f"{rounded('d_')} - {rounded('s_')}")
        out.add(**{f"c2_n{c}": f"s_{c} + c2_shift" for c in RGB})
        n = "c2_nr, c2_ng, c2_nb"
        out.add(c2_l=_luma("c2_n", FINE), c2_lo=f"least({n})", c2_hi=f"greatest({n})")
        out.add(**{f"c2_m{c}": f"CASE WHEN c2_lo < 0.0 THEN c2_l + (c2_n{c} - c2_l) * c2_l / greatest(c2_l - c2_lo, 0.000001) ELSE c2_n{c} END" for c in RGB})
        out.add(**{f"c2_{c}": f"CASE WHEN c2_hi > 1.0 THEN c2_l + (c2_m{c} - c2_l) * (1.0 - c2_l) / greatest(c2_hi - c2_l, 0.000001) ELSE c2_m{c} END" for c in RGB})
        out.add(**{f"raw_{c}": f"CASE WHEN c1_lo < 0.0 THEN c2_{c} ELSE c1_{c} END" for c in RGB})
    elif mode == 26:
        out.add(slum=_luma("s_", REC601))
        _set_lum(out, "d_", "slum", REC601, "b1")
        out.add(**{f"raw_{c}": f"b1_{c}" for c in RGB})


def float_blend(mode: int) -> Recipe:
    """Blend in doubles, mix by both alphas, round to bytes."""
    out = Recipe()
    out.add(sa_f="least(greatest(sa / 255.0 * (opacity / 256.0), 0.0), 1.0) * (mask / 255.0)", da_f="da / 255.0", **{f"s_{c}": f"s{c} / 255.0" for c in RGB}, **{f"d_{c}": f"d{c} / 255.0" for c in RGB})
    if mode in SEPARABLE:
        out.add(**{f"raw_{c}": SEPARABLE[mode].format(s=f"s_{c}", d=f"d_{c}") for c in RGB})
    else:
        _mixed(out, mode)
    kept = {c: f"least(greatest(raw_{c}, 0.0), 1.0)" for c in RGB}
    whole = kept if mode == 2 else {c: f"{byte(f'raw_{c}')} / 255.0" for c in RGB}
    if mode == 5:
        whole = {c: f"CASE WHEN sa_f > 0.0 AND sa_f < 1.0 AND s{c} = d{c} THEN 1.0 / 255.0 ELSE {whole[c]} END" for c in RGB}
    out.add(oa="sa_f + da_f * (1.0 - sa_f)", **{f"b_{c}": whole[c] for c in RGB})
    out.add(**{f"o_{c}": f"((1.0 - da_f) * s_{c} * sa_f + (1.0 - sa_f) * d_{c} * da_f + sa_f * da_f * b_{c}) / CASE WHEN oa > 0.0 THEN oa ELSE 1.0 END" for c in RGB})
    final = lambda x: f"CASE WHEN sa_f > 0.0 AND sa_f < 1.0 THEN CAST(floor(least(greatest({x}, 0.0), 1.0) * 255.0) AS BIGINT) ELSE {byte(x)} END" if mode == 23 else byte(x)
    out.add(**{c: f"CASE WHEN sa_f <= 0.0 THEN d{c} WHEN oa <= 0.0 THEN 255 ELSE {final(f'o_{c}')} END" for c in RGB}, a=f"CASE WHEN sa_f <= 0.0 THEN da WHEN oa <= 0.0 THEN 0 ELSE {final('oa')} END")
    return out


def byte_blend(mode: int) -> Recipe:
    """Blend and mix in integers, each mode with its own rounding."""
    out = Recipe()
    out.add(ea="((sa * mask) DIV 255) * opacity DIV 256")
    if mode == 0:
        out.add(carry="(da * (255 - ea)) DIV 255")
        out.add(oa="least(carry + ea, 255)")
        values = {c: f"least(greatest((s{c} * ea + d{c} * carry + (oa - 1) DIV 2) DIV greatest(oa, 1), 0), 255)" for c in RGB} | {"a": "oa"}
    elif mode == 12:
        out.add(rest="(da * (255 - ea) + 127) DIV 255", over="((255 - da) * ea + 127) DIV 255")
        out.add(den="greatest(rest + ea, 1)", den2="greatest(da + over, 1)")
        first = {c: f"least(CASE WHEN ea >= 255 THEN d{c} + s{c} WHEN da <= 254 THEN (rest * d{c} + (d{c} + s{c}) * ea) DIV den ELSE (rest * d{c} + (d{c} + s{c}) * ea + den DIV 2) DIV den END, 255)" for c in RGB}
        out.add(**{f"g_{c}": x for c, x in first.items()})
        values = {c: f"least(greatest(CASE WHEN da > 254 THEN g_{c} WHEN ea = 255 THEN ((255 - da) * s{c} + g_{c} * da + 127) DIV 255 ELSE (over * s{c} + g_{c} * da + den2 DIV 2) DIV den2 END, 0), 255)" for c in RGB} | {"a": "least(rest + ea, 255)"}
    elif mode == 10:
        out.add(num="ea * 255 + da * (255 - ea)", ea_f="ea / 255.0", da_f="da / 255.0", **{f"t_{c}": f"(s{c} * ea + 127) DIV 255" for c in RGB})
        out.add(oa_f="ea_f + da_f * (1.0 - ea_f)", black="da > 0 AND dr = 0 AND dg = 0 AND db = 0", den="greatest(num, 1)", **{f"j_{c}": f"CASE WHEN t_{c} >= 255 THEN 255 ELSE least(255, (d{c} * 255) DIV greatest(255 - t_{c}, 1)) END / 255.0" for c in RGB})
        out.add(part="CASE WHEN oa_f > 0.0 THEN least(da_f / oa_f, 1.0) ELSE 0.0 END", whole="CASE WHEN oa_f > 0.0 THEN oa_f ELSE 1.0 END")
        out.add(**{f"o_{c}": f"(j_{c} * oa_f * part + s{c} / 255.0 * ea_f * (1.0 - part)) / whole" for c in RGB})
        values = {c: f"CASE WHEN black THEN least((s{c} * ea * (255 - da) + den DIV 2) DIV den, 255) ELSE {byte(f'o_{c}')} END" for c in RGB} | {"a": f"CASE WHEN black THEN least(ea + da, 255) ELSE {byte('oa_f')} END"}
    else:
        blend = "CASE WHEN s{c} <= 0 THEN 0 ELSE 255 - least(255, ((255 - d{c}) * 255) DIV greatest(s{c}, 1)) END" if mode == 3 else "CASE WHEN s{c} >= 255 THEN 255 ELSE least(255, (d{c} * 255) DIV greatest(255 - s{c}, 1)) END"
        out.add(num="ea * 255 + da * (255 - ea)", **{f"j_{c}": blend.format(c=c) for c in RGB})
        out.add(den="greatest(num, 1)")
        values = {c: f"least(((255 - da) * s{c} * ea + (255 - ea) * d{c} * da + ea * da * j_{c} + den DIV 2) DIV den, 255)" for c in RGB} | {"a": "least((num + 127) DIV 255, 255)"}
    none = {c: f"d{c}" for c in RGB} | {"a": "da"}
    out.add(**{c: f"CASE WHEN ea = 0 THEN {none[c]} ELSE {x} END" for c, x in values.items()})
    return out


def preserve_blend(mode: int) -> Recipe:
    """Clipped siblings: the destination's alpha stays, the blend is mixed in by the source's (integers for the byte modes)."""
    if mode in BYTE_MODES and mode:
        out = Recipe().add(ea="((sa * mask) DIV 255) * opacity DIV 256")
        glow = "(s{c} * ea + 127) DIV 255"
        blend = {
            3: "CASE WHEN s{c} <= 0 THEN 0 ELSE 255 - least(255, ((255 - d{c}) * 255) DIV greatest(s{c}, 1)) END",
            9: "CASE WHEN s{c} >= 255 THEN 255 ELSE least(255, (d{c} * 255) DIV greatest(255 - s{c}, 1)) END",
            10: f"CASE WHEN {glow} >= 255 THEN 255 ELSE least(255, (d{{c}} * 255) DIV greatest(255 - {glow}, 1)) END",
            12: "least(d{c} + s{c}, 255)",
        }[mode]
        out.add(**{f"j_{c}": blend.format(c=c) for c in RGB})
        mix = {c: f"j_{c}" if mode == 10 else f"(d{c} * (255 - ea) + j_{c} * ea + 127) DIV 255" for c in RGB}
        return out.add(**{c: f"CASE WHEN ea = 0 THEN d{c} ELSE {x} END" for c, x in mix.items()}, a="da")
    out = float_blend(mode) if mode else Recipe().add(sa_f="least(greatest(sa / 255.0 * (opacity / 256.0), 0.0), 1.0) * (mask / 255.0)", **{f"s_{c}": f"s{c} / 255.0" for c in RGB}, **{f"d_{c}": f"d{c} / 255.0" for c in RGB}, **{f"b_{c}": f"s{c} / 255.0" for c in RGB})
    if mode:
        out.steps = out.steps[:-2]
    return out.add(**{c: byte(f"d_{c} * (1.0 - sa_f) + b_{c} * sa_f") for c in RGB}, a="da")


def blend(mode: int, preserve: bool = False) -> Recipe:
    """The recipe of a composite code."""
    if preserve:
        return preserve_blend(mode)
    return byte_blend(mode) if mode in BYTE_MODES else float_blend(mode)
