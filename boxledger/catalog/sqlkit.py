"""SQL fragments for the oracle texts; a rect named ``a`` has the columns ax, ay, aw, ah."""

from __future__ import annotations

from boxledger.functions import text


TIE_BIAS = 1.3e-10


def d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def r6(expr: str, name: str) -> str:
    """Six decimals; the bias moves exact ties and negative zero to one side in both engines."""
    return f"round({expr} + {d(TIE_BIAS)}, 6) AS {name}"


def r9(expr: str, name: str) -> str:
    """Nine decimals: for values that have seven or eight and would tie at six."""
    return f"round({expr}, 9) + {d(0.0)} AS {name}"


def area(a: str) -> str:
    return f"({a}w * {a}h)"


def contains(o: str, i: str, eps: float = 1e-6) -> str:
    return (
        f"({i}x + {d(eps)} >= {o}x AND {i}y + {d(eps)} >= {o}y AND {i}x + {i}w <= {o}x + {o}w + {d(eps)} "
        f"AND {i}y + {i}h <= {o}y + {o}h + {d(eps)})"
    )


def iou(a: str, b: str) -> str:
    iw = f"(least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
    ih = f"(least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"
    return (
        f"(CASE WHEN {iw} <= 0 OR {ih} <= 0 OR {a}w * {a}h + {b}w * {b}h - {iw} * {ih} <= 0 THEN {d(0.0)} "
        f"ELSE {iw} * {ih} / ({a}w * {a}h + {b}w * {b}h - {iw} * {ih}) END)"
    )


def iou_t(a: str, b: str) -> str:
    iw = f"greatest({d(0.0)}, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
    ih = f"greatest({d(0.0)}, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"
    un = f"(greatest({d(0.0)}, {a}w) * greatest({d(0.0)}, {a}h) + greatest({d(0.0)}, {b}w) * greatest({d(0.0)}, {b}h) - {iw} * {ih})"
    return f"(CASE WHEN {un} <= {d(1e-9)} THEN {d(0.0)} ELSE {iw} * {ih} / {un} END)"


def cdist(a: str, b: str) -> str:
    dx = f"({a}x + {a}w / 2.0::DOUBLE - ({b}x + {b}w / 2.0::DOUBLE))"
    dy = f"({a}y + {a}h / 2.0::DOUBLE - ({b}y + {b}h / 2.0::DOUBLE))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def gdist(a: str, b: str) -> str:
    return (
        f"(abs({a}x + {a}w / 2.0::DOUBLE - ({b}x + {b}w / 2.0::DOUBLE)) + abs({a}y + {a}h / 2.0::DOUBLE - ({b}y + {b}h / 2.0::DOUBLE))"
        f" + abs({a}w - {b}w) + abs({a}h - {b}h))"
    )


def overlap(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"greatest({d(0.0)}, least({a1}, {b1}) - greatest({a0}, {b0}))"


def gap(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"(CASE WHEN {a1} < {b0} THEN {b0} - ({a1}) WHEN {b1} < {a0} THEN {a0} - ({b1}) ELSE {d(0.0)} END)"


def adjacent(a: str, b: str) -> str:
    xs = (f"{a}x", f"{a}x + {a}w", f"{b}x", f"{b}x + {b}w")
    ys = (f"{a}y", f"{a}y + {a}h", f"{b}y", f"{b}y + {b}h")
    e, g = d(1e-6), d(0.04)
    return (
        f"(({overlap(*ys)} > {e} AND {gap(*xs)} > {e} AND {gap(*xs)} <= {g}) OR "
        f"({overlap(*xs)} > {e} AND {gap(*ys)} > {e} AND {gap(*ys)} <= {g}))"
    )


def size_delta(a: str, b: str) -> str:
    return (
        f"greatest(abs({a}w - {b}w) / greatest({a}w, {b}w, {d(1e-6)}), abs({a}h - {b}h) / greatest({a}h, {b}h, {d(1e-6)}))"
    )


def aspect(a: str) -> str:
    return f"(CASE WHEN {a}h > {d(1e-9)} THEN {a}w / {a}h ELSE {d(1.0)} END)"


def aspect_parity(a: str, b: str) -> str:
    return f"(least({aspect(a)}, {aspect(b)}) / greatest({aspect(a)}, {aspect(b)}, {d(1e-6)}))"


def duplicate(a: str, b: str) -> str:
    """D-7."""
    ar = f"(least({area(a)}, {area(b)}) / greatest({area(a)}, {area(b)}))"
    ra, rb = f"({a}w / greatest({d(1e-6)}, {a}h))", f"({b}w / greatest({d(1e-6)}, {b}h))"
    return (
        f"({area(a)} > 0 AND {area(b)} > 0 AND {iou(a, b)} >= {d(0.85)} AND {ar} >= {d(0.85)} AND "
        f"least({ra}, {rb}) / greatest({ra}, {rb}) >= {d(0.85)} AND NOT {contains(a, b)} AND NOT {contains(b, a)})"
    )


def clamp01(v: str) -> str:
    return f"least({d(1.0)}, greatest({d(0.0)}, {v}))"


# --- text ---------------------------------------------------------------------------------
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re_replace(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def clean_steps(src: str, value: str, keys: str) -> str:
    """CTE chain k1..k8 that applies the edge cleanup to ``value``, one column per step."""
    steps = [
        ("s_nbsp", value, text.NO_BREAK_SPACE, " "),
        ("s_zero", "s_nbsp", text.ZERO_WIDTH, ""),
        ("s_multi", "s_zero", text.MULTI_SPACE, " "),
        ("s_trim", "s_multi", text.TRIM, ""),
        ("s_lead", "s_trim", text.LEADING_JUNK, ""),
        ("s_iso", "s_lead", text.TRAILING_ISOLATED, ""),
        ("s_trail", "s_iso", text.TRAILING_JUNK, ""),
        ("s_final", "s_trail", text.TRIM, ""),
    ]
    out, prev = [], src
    for i, (name, inp, pattern, by) in enumerate(steps, 1):
        out.append(f"k{i} AS (SELECT *, {re_replace(inp, pattern, by)} AS {name} FROM {prev})")
        prev = f"k{i}"
    return ",\n".join(out)


def greedy_cte(name: str, src: str, keys: str, order: str, cond: str) -> str:
    """CTEs of an ordered keep-unless-conflict scan over ``src`` (columns keys, object_id, x, y, w, h).

    ``cond`` compares the kept box ``k.`` with the candidate ``o.``. Result: ``{name}_k`` with the kept ids.
    """
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"o.{k} = r.{k}" for k in ks)
    ok = ", ".join(f"o.{k}" for k in ks)
    box = "{{'id': {p}object_id, 'x': {p}x, 'y': {p}y, 'w': {p}w, 'h': {p}h}}"
    return f"""
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {src}),
{name}_r AS (SELECT {keys}, rn, [{box.format(p='')}] AS kept FROM {name}_o WHERE rn = 1
  UNION ALL SELECT {ok}, o.rn, CASE WHEN len(list_filter(r.kept, lambda k: {cond})) > 0 THEN r.kept
    ELSE list_append(r.kept, {box.format(p='o.')}) END FROM {name}_r r JOIN {name}_o o ON {on} AND o.rn = r.rn + 1),
{name}_z AS (SELECT {keys}, kept, row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) AS z FROM {name}_r),
{name}_u AS (SELECT {keys}, unnest(kept) AS b FROM {name}_z WHERE z = 1),
{name}_k AS (SELECT {keys}, b.id AS object_id FROM {name}_u)"""


def trivial(a: str, b: str) -> str:
    ar = f"(least({area(a)}, {area(b)}) / greatest({area(a)}, {area(b)}))"
    return (
        f"({area(a)} > 0 AND {area(b)} > 0 AND ({contains(a, b)} OR {contains(b, a)}) AND {ar} >= {d(0.95)} AND {iou(a, b)} >= {d(0.95)})"
    )


def parents_cte(name: str, src: str, keys: str = "doc_id, page_index") -> str:
    """``{name}``: the rows of ``src`` with parent_id by smallest containing other box."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    return f"""
{name}_c AS (SELECT {ak}, a.object_id, b.object_id AS parent_id,
   row_number() OVER (PARTITION BY {ak}, a.object_id ORDER BY {area('b.')}, b.input_ord, b.object_id) AS rn
   FROM {src} a JOIN {src} b ON {on} AND a.object_id <> b.object_id AND {contains('b.', 'a.')}),
{name} AS (SELECT a.*, b.parent_id FROM {src} a LEFT JOIN {name}_c b ON {on} AND a.object_id = b.object_id AND b.rn = 1)"""


def ancestors_cte(name: str, src: str, keys: str = "doc_id, page_index") -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    return f"""
{name} AS (SELECT {keys}, object_id, parent_id AS ancestor_id, 1 AS distance FROM {src} WHERE parent_id IS NOT NULL
  UNION ALL SELECT {ak}, a.object_id, b.parent_id, a.distance + 1 FROM {name} a JOIN {src} b ON {on} AND a.ancestor_id = b.object_id
  WHERE b.parent_id IS NOT NULL)"""


def hierarchy_cte(src: str, keys: str = "doc_id, page_index") -> str:
    """CTEs that turn ``src`` into ``tree`` (with parent_id, depth) and ``tree_anc``."""
    ks = [k.strip() for k in keys.split(",")]

    def on(a, b):
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)

    return f"""
{greedy_cte("triv", src, keys, f"confidence DESC, {area('')} DESC, object_id", trivial("k.", "o."))},
flat AS (SELECT s.* FROM {src} s JOIN triv_k k ON {on('s', 'k')} AND s.object_id = k.object_id),
{parents_cte("nest", "flat", keys)},
sib AS (SELECT *, coalesce(parent_id, '') AS grp FROM nest),
{greedy_cte("sibd", "sib", keys + ", grp", f"{area('')} DESC, object_id", duplicate("o.", "k."))},
lost AS (SELECT s.* FROM sib s WHERE NOT EXISTS (SELECT 1 FROM sibd_k k WHERE {on('s', 'k')} AND s.grp = k.grp AND s.object_id = k.object_id)),
heir AS (SELECT {', '.join('l.' + k for k in ks)}, l.object_id, s.object_id AS heir_id,
   row_number() OVER (PARTITION BY {', '.join('l.' + k for k in ks)}, l.object_id ORDER BY {area('s.')} DESC, s.object_id) AS rn
   FROM lost l JOIN sib s ON {on('l', 's')} AND l.grp = s.grp AND {duplicate('l.', 's.')}
   JOIN sibd_k k ON {on('s', 'k')} AND s.grp = k.grp AND s.object_id = k.object_id
   WHERE {area('s.')} > {area('l.')} OR ({area('s.')} = {area('l.')} AND s.object_id < l.object_id)),
tree0 AS (SELECT {', '.join('s.' + k for k in ks)}, s.object_id, s.input_ord, s.x, s.y, s.w, s.h, s.confidence, coalesce(r.heir_id, s.parent_id) AS parent_id FROM sib s
   JOIN sibd_k k ON {on('s', 'k')} AND s.grp = k.grp AND s.object_id = k.object_id
   LEFT JOIN heir r ON {on('s', 'r')} AND r.rn = 1 AND s.parent_id = r.object_id),
{ancestors_cte("tree_anc", "tree0", keys)},
tree AS (SELECT t.*, coalesce(a.n, 0) AS depth FROM tree0 t LEFT JOIN
  (SELECT {keys}, object_id, count(*) AS n FROM tree_anc GROUP BY ALL) a ON {on('t', 'a')} AND t.object_id = a.object_id)"""
