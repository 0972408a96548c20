"""Suffix arrays of one shard by induced sorting, in numpy.

`suffix_array` classifies suffixes as larger or smaller than their right neighbour, sorts
the leftmost-smaller (LMS) substrings, recurses on their names, whatever their number, and
induces the rest. Inducing goes through the array in order, but many suffixes at a time: all
up to the first one before which one of them may still put another (`_ready`). Where buckets
are small, as in reduced strings, or induce into themselves, as in periodic ones, such steps
would be short and suffixes go one by one (`_induce_singly`, about a microsecond each). The work
is linear in the text. `permuted_lcp` follows Kärkkäinen, Manzini and Puglisi (2009): only irreducible
positions are compared, all others follow from their left neighbour.
"""

from __future__ import annotations

import numpy as np

#: Suffixes looked at in a step, at most.
WINDOW = 1 << 16
#: Suffixes a bucket, on average, from which they are induced many at a time.
MANY = 64
#: Longer strings are too large for the cache to go singly.
SHORT = 1 << 18
#: Every so many steps they must have moved FEW suffixes each on average, or all go singly.
STEPS, FEW = 256, 4
#: Symbols of LMS substrings that are compared in step; what is still alike then goes by whole rests.
FAR = 64
#: Common prefixes are compared in step up to here.
LONG = 4096


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; t ends in a unique smallest symbol."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    nxt = change[np.searchsorted(change, np.arange(n - 1))] if len(change) else np.zeros(n - 1, int)
    out = np.ones(n, bool)
    out[:-1] = t[nxt] < t[nxt + 1]
    return out


def _deal(sa: np.ndarray, at: np.ndarray, js: np.ndarray, chars: np.ndarray, down: bool) -> None:
    """Puts js into their buckets in order: upwards from at[c], or downwards from at[c] - 1."""
    if not len(js):
        return
    order = np.argsort(chars, kind="stable")
    js, chars = js[order], chars[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    sizes = np.diff(np.r_[first, len(chars)])
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    heads = chars[first]
    if down:
        sa[at[chars] - 1 - rank] = js
        at[heads] -= sizes
    else:
        sa[at[chars] + rank] = js
        at[heads] += sizes


def _ready(place: np.ndarray, target: np.ndarray) -> int:
    """How many of the suffixes, in the order in which they induce, are surely next: place is
    twice the bucket, plus one for those that follow what is induced into their own bucket;
    target twice the bucket that each induces into."""
    before = np.minimum.accumulate(target)
    late = np.flatnonzero(place[1:] > before[:-1])
    return int(late[0]) + 1 if len(late) else len(place)


def _induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes in their given order."""
    n, k = len(t), len(starts) - 1
    if n < MANY * k and n < SHORT:
        return _induce_singly(t, small, starts, lms)
    none = 2 * k + 2
    sa = np.full(n, -1, np.int64)
    placed = lms[np.argsort(t[lms], kind="stable")]  # by bucket, in order
    head, tail = starts[:-1].copy(), starts[1:].copy()
    # larger suffixes, upwards: those induced so far and, after them in each bucket, the LMS ones
    at = taken = 0
    wide = 256
    steps = moved = 0
    while at < n or taken < len(placed):
        own = sa[at : at + wide]
        slots = np.flatnonzero(own >= 0)
        own, fixed = own[slots], placed[taken : taken + wide]
        place, other = 2 * t[own].astype(np.int64), 2 * t[fixed].astype(np.int64) + 1
        if at + wide < n:  # later slots may belong before these
            other = other[other < 2 * (np.searchsorted(starts, at + wide, side="right") - 1)]
        if len(other) < len(fixed) or taken + wide >= len(placed):
            fixed = fixed[: len(other)]
        if taken + wide < len(placed) and len(other) == wide:  # nor may unseen LMS ones
            keep = int(np.searchsorted(place, other[-1], side="right"))
            own, place, slots = own[:keep], place[:keep], slots[:keep]
            whole = False
        else:
            whole = True
        order = np.argsort(np.r_[place, other], kind="stable")
        js, keys = np.r_[own, fixed][order], np.r_[place, other][order]
        if not len(js):
            at += wide
            continue
        left = np.maximum(js - 1, 0)
        good = (js > 0) & ~small[left]
        m = _ready(keys, np.where(good, 2 * t[left].astype(np.int64), none))
        left = left[:m][good[:m]]
        _deal(sa, head, left, t[left], False)
        steps, moved = steps + 1, moved + m
        if steps == STEPS:
            if moved < FEW * STEPS:
                return _induce_singly(t, small, starts, lms)
            steps = moved = 0
        used = int((order[:m] < len(own)).sum())
        taken += m - used
        if m < len(js):
            at += int(slots[used - 1]) + 1 if used else 0
            wide = max(64, min(wide, 4 * m))
        else:
            if whole:  # new ones in slots just seen are seen again
                fresh = np.flatnonzero(sa[at : at + wide] >= 0)
                at += int(slots[-1]) + 1 if len(fresh) > len(slots) and len(slots) else int(fresh[0]) if len(fresh) > len(slots) else wide
            elif used:
                at += int(slots[used - 1]) + 1
            wide = min(WINDOW, 2 * wide)
    # smaller suffixes, downwards: they stand after the larger ones of their bucket
    at, wide = n, 256
    steps = moved = 0
    while at > 0:
        low = max(0, at - wide)
        own = sa[low:at][::-1]
        slots = np.flatnonzero(own >= 0)
        js = own[slots]
        if not len(js):
            at = low
            continue
        left = np.maximum(js - 1, 0)
        good = (js > 0) & small[left]
        keys = 2 * (k - t[js].astype(np.int64)) + ~small[js]
        m = _ready(keys, np.where(good, 2 * (k - t[left].astype(np.int64)), none))
        left = left[:m][good[:m]]
        _deal(sa, tail, left, t[left], True)
        steps, moved = steps + 1, moved + m
        if steps == STEPS:
            if moved < FEW * STEPS:
                return _induce_singly(t, small, starts, lms)
            steps = moved = 0
        if m < len(js):
            at -= int(slots[m - 1]) + 1
            wide = max(64, min(wide, 4 * m))
        else:
            fresh = np.flatnonzero(sa[low:at][::-1] >= 0)
            at = at - (int(slots[-1]) + 1) if len(fresh) > len(slots) else low
            wide = min(WINDOW, 2 * wide)
    sa[0] = n - 1  # the closing symbol, which nothing induces
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    placed = lms[np.argsort(t[lms], kind="stable")]
    chars = t[placed]
    behind = np.searchsorted(chars, chars, side="right") - np.arange(len(placed))  # LMS suffixes from here to the bucket's end
    sa = np.full(n, -1, np.int64)
    sa[starts[chars + 1] - behind] = placed
    sa, symbol, smaller = sa.tolist(), t.tolist(), small.tolist()
    head = starts[:-1].tolist()
    for j in sa:  # grows as it is walked
        if j > 0 and not smaller[j - 1]:
            c = symbol[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = starts[1:].tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i]
        if j > 0 and smaller[j - 1]:
            c = symbol[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    return np.array(sa, np.int64)


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of LMS substrings, in text order, by their rank. A symbol of a larger suffix goes
    before the same symbol of a smaller one, so no substring begins another. Symbols are
    compared several at a time, packed in 64 bits; those that still are alike go on."""
    code = 2 * t.astype(np.uint64) + small.astype(np.uint64)
    bits = int(code.max()).bit_length()
    per = 64 // bits
    length = np.diff(np.r_[lms, len(t) - 1]) + 1
    name = np.zeros(len(lms), np.int64)  # how many are smaller, as far as known
    active, done = np.arange(len(lms)), 0
    while len(active):
        if done >= FAR:
            _name_rests(code, lms, length, name, active, done)
            break
        word = np.zeros(len(active), np.uint64)
        at, room = lms[active] + done, length[active] - done
        for j in range(per):
            inside = j < room
            word <<= np.uint64(bits)
            word[inside] |= code[at[inside] + j]
        order = np.argsort(word, kind="stable")
        if done:
            order = order[np.argsort(name[active[order]], kind="stable")]
        active, word, own = active[order], word[order], name[active[order]]
        new = np.r_[True, own[1:] != own[:-1]]  # groups so far, then also by this word
        begin = np.flatnonzero(new)
        new[1:] |= word[1:] != word[:-1]
        parts = np.flatnonzero(new)
        sizes = np.diff(np.r_[parts, len(active)])
        inner = parts - begin[np.searchsorted(begin, parts, side="right") - 1]
        name[active] = np.repeat(own[parts] + inner, sizes)
        done += per
        active = active[np.repeat(sizes > 1, sizes) & (length[active] > done)]
    return np.unique(name, return_inverse=True)[1]


def _name_rests(code: np.ndarray, lms: np.ndarray, length: np.ndarray, name: np.ndarray, active: np.ndarray, done: int) -> None:
    """Parts groups of equal names by all symbols from `done` on. Rests don't overlap, so together
    they aren't longer than the text."""
    raw = code.astype(">u4" if code.max() < 1 << 32 else ">u8")
    rests = sorted((name[i], raw[lms[i] + done : lms[i] + length[i]].tobytes(), i) for i in active.tolist())
    group = first = None
    for k, (own, rest, i) in enumerate(rests):
        if own != group:
            group, begin, first = own, k, None
        if rest != first:
            first, rank = rest, k - begin
        name[i] = own + rank


def _order(names: np.ndarray) -> np.ndarray:
    """Places of a string's suffixes in order; names has no gaps and ends in a 0 found nowhere
    else. A suffix whose first name is unique has its place already, and no comparison goes on
    behind it: of several unique names in a row all but the first are left out of the string
    that is sorted recursively."""
    total = np.bincount(names)
    unique = total[names] == 1
    first = np.cumsum(total) - total
    order = np.empty(len(names), np.int64)
    order[first[names[unique]]] = np.flatnonzero(unique)
    if not unique.all():
        kept = np.flatnonzero(~unique | np.r_[True, ~unique[:-1]])
        kept = kept if kept[-1] == len(names) - 1 else np.r_[kept, len(names) - 1]
        _, short = np.unique(names[kept], return_inverse=True)
        found = kept[suffix_array(short)]
        order[np.repeat(total > 1, total)] = found[~unique[found]]
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: non-negative integers that end in a 0 found nowhere else."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = _smaller(t)
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return _induce(t, small, starts, lms[_order(_names(t, small, lms))])


def _common(t: np.ndarray, x: int, y: int, done: int, end: int) -> int:
    """The common prefix of two suffixes, of which `done` symbols are known; `end` at most."""
    size = 1024
    while done < end:
        size = min(2 * size, end - done)
        differ = t[x + done : x + done + size] != t[y + done : y + done + size]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += size
    return end


def permuted_lcp(t: np.ndarray, sa: np.ndarray, room: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, before): before[i] is the suffix sorted just before i (-1 for the first), plcp[i]
    their common prefix, at most room[i] and room[before[i]] symbols long. Values under
    `least` may come out as any other value under it."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    irreducible = np.ones(n, bool)
    # neighbours by chance, whose first symbols differ, say nothing about the next positions
    irreducible[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (t[:-1] != t[before[:-1]])
    irreducible[0] = True
    heads = np.flatnonzero(irreducible)
    packed = np.zeros(n + 8, np.uint64)
    wide = np.r_[t, np.zeros(16, t.dtype)].astype(np.uint64)
    for j in range(8):
        packed[:n] = (packed[:n] << np.uint64(8)) | (wide[j : j + n] & np.uint64(255))
    value = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(before[heads] >= 0)
    for probe in range(0, least - 7, 32):  # most differ at one of these already
        x, y = heads[live] + probe, before[heads[live]] + probe
        live = live[packed[np.minimum(x, n)] == packed[np.minimum(y, n)]]
    a, b = heads[live], before[heads[live]]
    limit = np.minimum(n - a, n - b)
    off = np.zeros(len(live), np.int64)
    while len(live):
        if off[0] >= LONG:  # few are that long: each by growing blocks
            for i, x, y, done, end in zip(*(v.tolist() for v in (live, a, b, off, limit))):
                value[i] = _common(t, x, y, done, end)
            break
        x = packed[np.minimum(a + off, n)] ^ packed[np.minimum(b + off, n)]
        more = (x == 0) & (off + 8 < limit)
        stop = ~more
        y = x[stop]
        top = np.zeros(len(y), np.int64)  # exact count of equal leading bytes
        alive = np.ones(len(y), bool)
        for j in range(8):
            alive &= ((y >> np.uint64(56 - 8 * j)) & np.uint64(255)) == 0
            top += alive
        value[live[stop]] = np.minimum(off[stop] + top, limit[stop])
        live, a, b, off, limit = live[more], a[more], b[more], off[more] + 8, limit[more]
    which = np.cumsum(irreducible) - 1
    plcp = np.maximum(value[which] - (np.arange(n) - heads[which]), 0)
    plcp[before < 0] = 0
    return np.minimum(plcp, np.where(before >= 0, np.minimum(room, room[before]), 0)), before


def repeated_windows(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece: True at each start of a width-byte string that starts anywhere else."""
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1  # of the separators
    t = raw.astype(np.int16) + 2
    t[ends] = 1
    t[-1] = 0
    room = np.zeros(len(t), np.int64)
    begin = ends - sizes
    room[: ends[-1] + 1] = np.repeat(ends, sizes + 1) - np.arange(ends[-1] + 1)
    sa = suffix_array(t)
    plcp, before = permuted_lcp(t, sa, room, width)
    hit = np.zeros(len(t), bool)
    twin = plcp >= width
    hit[twin] = True
    hit[before[twin]] = True
    return [hit[s : s + max(0, n - width + 1)] for s, n in zip(begin, sizes)]
