"""The vocabulary in which factors are written.

A factor is an ordinary Python expression over bar fields and the functions below.  Each
function makes a :class:`Term`, which only says what to compute; ``plans.panel`` turns
terms into projections and windows over a panel.

Missing values are NULL.  Ranks and positions compare values to nine significant digits, and take
what is below 1e-12 for zero, so that rounding noise does not split ties.  Infinities may arise between infix operations; every named
function first turns them into NULL.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    """kind: field, value, el (row by row), ts and sl (per instrument over the last n bars), run (from its first bar on), cs (per time over instruments)."""

    kind: str
    op: str
    args: tuple = ()
    params: tuple = ()

    def __add__(self, o): return _infix("+", self, o)
    def __radd__(self, o): return _infix("+", o, self)
    def __sub__(self, o): return _infix("-", self, o)
    def __rsub__(self, o): return _infix("-", o, self)
    def __mul__(self, o): return _infix("*", self, o)
    def __rmul__(self, o): return _infix("*", o, self)
    def __truediv__(self, o): return _infix("/", self, o)
    def __rtruediv__(self, o): return _infix("/", o, self)
    def __pow__(self, o): return _infix("pow", self, o)
    def __rpow__(self, o): return _infix("pow", o, self)
    def __neg__(self): return _infix("*", -1.0, self)
    def __lt__(self, o): return _infix("<", self, o)
    def __le__(self, o): return _infix("<=", self, o)
    def __gt__(self, o): return _infix(">", self, o)
    def __ge__(self, o): return _infix(">=", self, o)
    def __or__(self, o): return _infix("or", self, o)
    def __and__(self, o): return _infix("and", self, o)
    def equals(self, o): return _infix("=", self, o)
    def differs(self, o): return _infix("<>", self, o)


def term(x) -> Term:
    return x if isinstance(x, Term) else Term("value", repr(float(x)))


def _infix(op, a, b) -> Term:
    return Term("el", op, (term(a), term(b)))


def field(name: str) -> Term:
    return Term("field", name)


def clean(x) -> Term:
    x = term(x)
    return x if x.kind in ("field", "value", "ts", "sl", "run", "cs") or x.op in ("clean", "<", "<=", ">", ">=", "=", "<>", "or", "and") else Term("el", "clean", (x,))


def _el(op, *args, params=()):
    return Term("el", op, tuple(clean(a) for a in args), params)


def _ts(op, n, *args):
    return Term("ts", op, tuple(clean(a) for a in args), (int(n),))


def _both(x, y):
    """Each of a pair where both are present."""
    x, y = clean(x), clean(y)
    return Term("el", "if_present", (x, y)), Term("el", "if_present", (y, x))


open_, high, low, close, volume, amount = (field(n) for n in ("open", "high", "low", "close", "vol", "amount"))


# Over time.  Window lengths are truncated to whole bars; windows are strict: NULL unless all bars have a value.
def delay(x, n): return _ts("lag", n, x)
def delta(x, n): return clean(x) - delay(x, n)
def ts_returns(x, n): return clean(x) / delay(x, n) - 1
def ts_mean(x, n): return _ts("avg", n, x)
def ts_std(x, n): return _ts("stddev_samp", n, x)
def ts_max(x, n): return _ts("max", n, x)
def ts_min(x, n): return _ts("min", n, x)
def ts_sum(x, n): return _ts("sum", n, x)
def _sl(op, n, x): return Term("sl", op, (clean(x),), (int(n),))
def ts_product(x, n): return _sl("product", n, x)
def _steady(x): return Term("el", "steady", (clean(x),))
def ts_rank(x, n): return _sl("rank", n, _steady(x))
def ts_argmax(x, n): return _sl("argmax", n, _steady(x))
def ts_argmin(x, n): return _sl("argmin", n, _steady(x))
def decay_linear(x, n): return _sl("decay", n, x)
def ts_cov(x, y, n): return _ts("covar_pop", n, *_both(x, y))
def ts_corr(x, y, n):
    """Population covariance over sample deviations: Pearson's times (n - 1) / n."""
    a, b = _both(x, y)
    return Term("el", "ratio", (_ts("covar_pop", n, a, b), ts_std(a, n), ts_std(b, n), ts_max(abs_(a), n), ts_max(abs_(b), n)))  # a spread below 1e-10 of the values is none
def running(op, x): return Term("run", op, (clean(x),))


# Over the instruments of one time.
def rank(x): return Term("cs", "rank", (_steady(x),))
def scale(x, a=1): return Term("cs", "scale", (clean(x),), (float(a),))
def neutralize(x, g): return Term("cs", "neutralize", (clean(x), g))
def clip_rank(x, lower=0.01, upper=0.99):
    x = clean(x)
    return rank(Term("el", "clip", (x, Term("cs", "percentile", (x,), (lower,)), Term("cs", "percentile", (x,), (upper,)))))


# Row by row.
def log(x): return _el("log", x)
def sign(x): return _el("sign", x)
def signed_sqrt(x): return _el("signed_sqrt", x)
def signed_power(x, p): return _el("signed_power", x, p)
def safe_div(a, b): return _el("safe_div", a, b)
def min_(a, b): return _el("least", a, b)
def max_(a, b): return _el("greatest", a, b)
def abs_(x): return Term("el", "abs", (term(x),))
def sin(x): return Term("el", "sin", (term(x),))
def sqrt(x): return Term("el", "sqrt", (term(x),))
def pow_(x, p): return term(x) ** p
def while_valid(x): return Term("el", "if_present", (clean(x), field("valid_")))  # NULL from the first bad bar of a date on
def where(c, a, b): return Term("el", "where", (term(c), term(a), term(b)))


vwap = Term("el", "safe_div", (running("total", amount), running("total", volume)))
high_so_far, low_so_far, open0 = running("max", high), running("min", low), running("first", open_)
returns = ts_returns(close, 1)


def adv(n: int) -> Term:
    return ts_mean(volume, n)
