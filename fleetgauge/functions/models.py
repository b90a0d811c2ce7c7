"""Closed-form equipment models as Column expressions.

Every function takes a mapping ``p`` of parameter name to Column (or number)
and returns named Columns, so parameters may come from a join, a literal or an
array element, and the whole prediction stays inside one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.functions.cols import clip, col, dbl

CP = 4180.0
CP_HX = 4186.0

# --- fixed values: default chiller curves ---------------------------------------------------------
CAP_FT = [0.8085529, 0.03412026, -0.0004184591, 0.004111323, -0.0001764627, 0.0004184748]
EIR_FT = [0.6329473, 0.005521802, 0.0001487172, 0.002433576, 0.0007100129, -0.001108627]
EIR_FPLR = [0.24019, 0.5090345, 0.2500532]
# --- fixed values: default tower water-flow correction and fan curve --------------------------------
C_WAT_FRA = [0.1082, 1.667, -0.7713]
FAN_BREAKS = [0.0, 0.1, 0.3, 0.6, 1.0]
# --- fixed values: York approach polynomial, index 9p + 3q + r for T^r R^q L^p -----------------------
YORK = [
    -0.359741205, -0.055053608, 0.0023850432,
    0.173926877, -0.0248473764, 0.00048430224,
    -0.005589849456, 0.0005770079712, -0.00001342427256,
    2.84765801111111, -0.121765149, 0.0014599242,
    1.680428651, -0.0166920786, -0.0007190532,
    -0.025485194448, 0.0000487491696, 0.00002719234152,
    -0.0653766255555556, -0.002278167, 0.0002500254,
    -0.0910565458, 0.00318176316, 0.000038621772,
    -0.0034285382352, 0.00000856589904, -0.000001516821552,
]
# --- fixed values: validity box of that polynomial ----------------------------------------------------
YORK_BOX = {"twb": (-34.4, 26.7), "range": (1.1, 22.2), "approach": (1.1, 40.0), "fr_wat": (0.75, 1.25)}
YORK_MAX_APPROACH = 40.0


def _v(x) -> Column:
    return x if isinstance(x, Column) else (col(x) if isinstance(x, str) else dbl(x))


def _floor(x, lo):
    return F.greatest(x, dbl(lo))


def biquadratic(c, x, y) -> Column:
    return _v(c[0]) + _v(c[1]) * x + _v(c[2]) * x * x + _v(c[3]) * y + _v(c[4]) * y * y + _v(c[5]) * x * y


def _chiller_outputs(t_ent, t_con, m_eva, m_con, q, p):
    ev, cn = _floor(_floor(_v(m_eva), 0.0) * dbl(CP), 1.0), _floor(_floor(_v(m_con), 0.0) * dbl(CP), 1.0)
    return {"Q_s": q, "P_s": p, "COP_s": q / _floor(p, 1.0), "TEvaLvg_s": _v(t_ent) - q / ev, "TConLvg_s": _v(t_con) + (q + p) / cn}


def _requested(m_eva, t_ent, t_set):
    return _floor(_v(m_eva), 0.0) * dbl(CP) * _floor(_v(t_ent) - _v(t_set), 0.0)


def chiller_eir(p, t_ent, t_set, t_con, m_eva, m_con, y=1.0) -> dict[str, Column]:
    """Electric chiller from three curves: capacity, efficiency, part load."""
    ts, tc, yy = _v(t_set), _v(t_con), clip(_v(y), 0.0, 1.0)
    cap = _floor(biquadratic(p["cap"], ts, tc), 0.05)
    eir = _floor(biquadratic(p["eir"], ts, tc), 0.05)
    avail = F.abs(_v(p["QEva_flow_nominal"])) * cap
    plr = F.when(yy <= _v(p.get("yMin", 0.05)), dbl(0.0)).otherwise(
        F.least(F.greatest(_requested(m_eva, t_ent, t_set) / _floor(avail, 1.0), _v(p.get("PLRMin", 0.1))), _v(p.get("PLRMax", 1.2))))
    c = p["plr"]
    part = _floor(_v(c[0]) + _v(c[1]) * plr + _v(c[2]) * plr * plr, 0.05)
    power = F.when(plr <= 0, dbl(0.0)).otherwise(avail / _floor(_v(p["COP_nominal"]), 0.1) * eir * part / _floor(_v(p.get("etaMotor", 1.0)), 0.1))
    return {**_chiller_outputs(t_ent, t_con, m_eva, m_con, avail * plr, power), "PLR_s": plr}


def chiller_carnot(p, t_ent, t_set, t_con, m_eva, m_con, y=1.0) -> dict[str, Column]:
    """Carnot effectiveness with a part-load polynomial."""
    yy, qn = clip(_v(y), 0.0, 1.0), F.abs(_v(p["QEva_flow_nominal"]))
    plr = F.when(yy <= _v(p.get("yMin", 0.05)), dbl(0.0)).otherwise(
        F.least(F.greatest(_requested(m_eva, t_ent, t_set) / _floor(qn, 1.0), _v(p.get("PLRMin", 0.05))), _v(p.get("PLRMax", 1.2))))
    a = p.get("a", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    part, power_of = _v(a[0]), plr
    for k in range(1, 6):
        part, power_of = part + _v(a[k]) * power_of, power_of * plr
    cop = _floor(_v(p.get("etaCarnot_nominal", 0.45)) * _floor(part, 0.05) * (_v(t_set) + dbl(273.15)) / _floor(_v(t_con) - _v(t_set), 1.0), 0.1)
    q = qn * plr
    return {**_chiller_outputs(t_ent, t_con, m_eva, m_con, q, F.when(plr <= 0, dbl(0.0)).otherwise(q / cop)), "PLR_s": plr}


def pump_power(p, m_flow, y) -> dict[str, Column]:
    ys = F.least(F.greatest(_v(y), _v(p.get("y_min", 0.05))), _v(p.get("y_max", 1.2)))
    phi = _floor(_floor(_v(m_flow), 0.0) / _floor(_v(p["m_flow_nominal"]), 1e-6), 0.0)
    c = p["c"]
    return {"P_s": _floor(_v(p["P_nominal"]) * (_v(c[0]) + _v(c[1]) * phi + _v(c[2]) * ys + _v(c[3]) * ys * ys * ys + _v(c[4]) * phi * ys), 0.0),
            "phi_s": phi, "y_s": ys}


def fan_curve(alpha) -> list[Column]:
    """Relative power at the fixed break points for one exponent."""
    return [F.pow(dbl(b), _v(alpha)) for b in FAN_BREAKS]


def fan_relative_power(curve, fr_air) -> Column:
    """Piecewise-linear relative fan power."""
    out = None
    for i in range(4):
        a, b = FAN_BREAKS[i], FAN_BREAKS[i + 1]
        seg = _v(curve[i]) + (_v(curve[i + 1]) - _v(curve[i])) * (fr_air - dbl(a)) / dbl(round(b - a, 1))
        last = i == 3
        out = F.when(fr_air <= b, seg) if out is None else (out.otherwise(seg) if last else out.when(fr_air <= b, seg))
    return out


def merkel(p, t_in, t_wb, m_flow, y, t_range) -> dict[str, Column]:
    m = _floor(_v(m_flow), 0.0)
    wat = m / _floor(_v(p["m_flow_nominal"]), 1e-6)
    air = F.least(F.greatest(_v(y), _v(p.get("yMin", 0.05))), dbl(1.0))
    c = p.get("cWatFra", C_WAT_FRA)
    ua = _floor(_v(c[0]) + _v(c[1]) * wat + _v(c[2]) * wat * wat, 0.05)
    app = _floor(_v(t_range) / _floor(dbl(1.0) + ua * air / _floor(wat * _v(p["ratWatAir_nominal"]), 0.05), 1.0), 0.0)
    t_out = _v(t_wb) + app
    out = {"TOut_s": t_out, "TApp_s": app, "Q_s": m * dbl(CP) * (_v(t_in) - t_out)}
    if "PFan_nominal" in p:
        out["PFan_s"] = _v(p["PFan_nominal"]) * fan_relative_power(p["curve"], air)
    return out


def _hx_outputs(eps, c1, c2, t1, t2):
    q = eps * F.least(c1, c2) * _floor(_v(t1) - _v(t2), 0.0)
    return {"Q_s": q, "T1Out_s": _v(t1) - q / _floor(c1, 1.0), "T2Out_s": _v(t2) + q / _floor(c2, 1.0), "eps_s": eps}


def hx_constant(p, t1, t2, m1, m2) -> dict[str, Column]:
    c1, c2 = _floor(_v(m1), 0.0) * dbl(CP_HX), _floor(_v(m2), 0.0) * dbl(CP_HX)
    return _hx_outputs(clip(_v(p["eps"]), 0.0, 1.0), c1, c2, t1, t2)


def hx_plate(p, t1, t2, m1, m2) -> dict[str, Column]:
    """Plate exchanger: nominal UA scaled by both flows, effectiveness from NTU."""
    f1, f2 = _floor(_v(m1), 0.0), _floor(_v(m2), 0.0)
    c1, c2 = f1 * dbl(CP_HX), f2 * dbl(CP_HX)
    cmin, cmax = F.least(c1, c2), F.greatest(c1, c2)
    cr = cmin / _floor(cmax, 1.0)
    d1, d2 = _floor(_v(p["T_a1_nominal"]) - _v(p["T_b2_nominal"]), 0.1), _floor(_v(p["T_b1_nominal"]) - _v(p["T_a2_nominal"]), 0.1)
    lm = F.when(F.abs(d1 - d2) < 0.01, d1).otherwise((d1 - d2) / F.nullif(F.ln(d1 / d2), dbl(0.0)))
    ua = (F.abs(_v(p["Q_flow_nominal"])) / _floor(lm, 0.1) * F.pow(f1 / _floor(_v(p["m1_flow_nominal"]), 1e-6), _v(p.get("n1", 0.8)))
          * F.pow(f2 / _floor(_v(p["m2_flow_nominal"]), 1e-6), _v(p.get("n2", 0.8))) * _floor(_v(p.get("r_nominal", 1.0)), 0.05))
    ntu = ua / _floor(cmin, 1.0)
    ex = F.exp(-ntu * (dbl(1.0) - cr))
    eps = F.when(F.abs(dbl(1.0) - cr) < 0.001, ntu / (dbl(1.0) + ntu)).otherwise((dbl(1.0) - ex) / F.nullif(dbl(1.0) - cr * ex, dbl(0.0)))
    return {**_hx_outputs(clip(eps, 0.0, 1.0), c1, c2, t1, t2), "UA_s": ua}


# ---- York approach polynomial ------------------------------------------------------------------------
def york_design(twb, t_range, rlg) -> list[Column]:
    """The 27 monomials T^r R^q L^p in coefficient order."""
    t, r, g = _v(twb), _v(t_range), _v(rlg)
    tt, rr, ll = [dbl(1.0), t, t * t], [dbl(1.0), r, r * r], [dbl(1.0), g, g * g]
    return [tt[k] * rr[q] * ll[p] for p in range(3) for q in range(3) for k in range(3)]


def york_design_slope(twb, t_range, rlg) -> list[Column]:
    """d/dR of the monomials."""
    t, r, g = _v(twb), _v(t_range), _v(rlg)
    tt, dr, ll = [dbl(1.0), t, t * t], [dbl(0.0), dbl(1.0), dbl(2.0) * r], [dbl(1.0), g, g * g]
    return [tt[k] * dr[q] * ll[p] for p in range(3) for q in range(3) for k in range(3)]


def _dot(cols, f) -> Column:
    out = None
    for c, x in zip(cols, f):
        term = _v(x) * c
        out = term if out is None else out + term
    return out


def york_approach(twb, t_range, rlg, f=YORK) -> Column:
    return _dot(york_design(twb, t_range, rlg), f)


def york_sensitivity(twb, t_range, rlg, f=YORK) -> Column:
    return _dot(york_design_slope(twb, t_range, rlg), f)


def york_open_loop(twb, t_range, rlg, f=YORK) -> dict[str, Column]:
    """Outlet from the measured range: wet bulb plus the clipped approach."""
    a = clip(york_approach(twb, t_range, rlg, f), 0.0, YORK_MAX_APPROACH)
    return {"TApp_s": a, "TOut_s": _v(twb) + a}


def _range_quadratic(twb, rlg, f):
    """For a fixed wet bulb and ratio the polynomial is alpha + beta R + gamma R^2."""
    t, g = _v(twb), _v(rlg)
    tt, ll = [dbl(1.0), t, t * t], [dbl(1.0), g, g * g]
    out = []
    for q in range(3):
        acc = dbl(0.0)
        for p in range(3):
            for k in range(3):
                acc = acc + _v(f[9 * p + 3 * q + k]) * tt[k] * ll[p]
        out.append(acc)
    return out


def york_closed_loop_terms(t_in, twb, rlg, f=YORK) -> dict[str, Column]:
    """Quadratic ``A a^2 + B a + C = 0`` for the approach when the range is the model's own."""
    al, be, ga = _range_quadratic(twb, rlg, f)
    d = F.greatest(_v(t_in) - _v(twb), dbl(0.0))
    return {"D": d, "A": ga, "B": -(be + dbl(2.0) * ga * d + dbl(1.0)), "C": al + be * d + ga * d * d}


def york_closed_loop(A="A", B="B", C="C", D="D") -> dict[str, Column]:
    """Smallest admissible root in ``[0, min(D, 40)]``, root count and clipped zero.

    Where the polynomial is at or below zero at a zero approach the clip makes
    zero an exact solution; that is reported separately as ``clipped``.
    """
    a, b, c, d = _v(A), _v(B), _v(C), F.least(_v(D), dbl(YORK_MAX_APPROACH))
    disc = b * b - dbl(4.0) * a * c
    linear = F.abs(a) < 1e-12
    root = F.sqrt(F.greatest(disc, dbl(0.0)))
    q = dbl(-0.5) * (b + F.when(b >= 0, root).otherwise(-root))  # avoids cancellation
    r1 = F.when(linear, -c / F.nullif(b, dbl(0.0))).when(disc >= 0, q / F.nullif(a, dbl(0.0)))
    r2 = F.when(~linear & (disc >= 0), c / F.nullif(q, dbl(0.0)))

    def ok(r):
        return F.when((r >= 0) & (r <= d), r)
    roots = F.array_compact(F.array(ok(r1), ok(r2)))
    clipped = c <= 0
    tapp = F.when(clipped, dbl(0.0)).otherwise(F.array_min(roots))
    return {"TApp_s": tapp, "clipped": clipped, "admissible": tapp.isNotNull(), "n_roots": F.size(roots)}


def york_frwat0(twb, t_range, approach, f=YORK, lo: float = 1e-3, hi: float = 8.0) -> Column:
    """Smallest ratio L in [lo, hi] whose approach equals the design approach (quadratic in L)."""
    t, r = _v(twb), _v(t_range)
    tt, rr = [dbl(1.0), t, t * t], [dbl(1.0), r, r * r]
    c = []
    for p in range(3):
        acc = dbl(0.0)
        for q in range(3):
            for k in range(3):
                acc = acc + _v(f[9 * p + 3 * q + k]) * tt[k] * rr[q]
        c.append(acc)
    a, b, z = c[2], c[1], c[0] - _v(approach)
    disc = b * b - dbl(4.0) * a * z
    linear = F.abs(a) < 1e-12
    root = F.sqrt(F.greatest(disc, dbl(0.0)))
    q = dbl(-0.5) * (b + F.when(b >= 0, root).otherwise(-root))
    r1 = F.when(linear, -z / F.nullif(b, dbl(0.0))).when(disc >= 0, q / F.nullif(a, dbl(0.0)))
    r2 = F.when(~linear & (disc >= 0), z / F.nullif(q, dbl(0.0)))
    return F.array_min(F.array_compact(F.array(*[F.when((x >= lo) & (x <= hi), x) for x in (r1, r2)])))


def york_in_domain(twb, t_range, approach, fr_wat) -> Column:
    def inside(x, key):
        lo, hi = YORK_BOX[key]
        return (_v(x) >= lo) & (_v(x) <= hi)
    return inside(twb, "twb") & inside(t_range, "range") & inside(approach, "approach") & inside(fr_wat, "fr_wat")


