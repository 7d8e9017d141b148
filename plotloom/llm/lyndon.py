"""Suffix arrays by linear grouping: suffixes grouped by their Lyndon prefix, then sorted within the groups.

Many independent strings are sorted side by side. In every step each string works on its own highest group that is not
done yet, and the steps of all strings are one set of array operations.
"""

from __future__ import annotations

import numpy as np

from plotloom.llm.common import ragged


def suffix_arrays(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The suffix array of each string, as positions in ``text``, laid out where the string is.

    Strings are text[begin[i]:begin[i + 1]]; each ends with a character smaller than all its others. Characters are small
    non-negative integers.

    Groups are intervals of the array, named by their first place; a suffix's group says what Lyndon word its prefix is known
    to start with, and group order is the words' order. From the highest group down: every suffix of the group looks up
    the nearest suffix before it in a lower group (its previous smaller one); those suffixes' Lyndon prefixes grow by
    as many copies of this group's word as suffixes point to them, so they move, by group and number, into new groups right
    above their own. Afterwards the groups are final, and one pass over the array in ascending order puts the suffixes
    into their groups: after suffix i, the one before it, and then that one's previous smaller ones, come next in their
    groups, unless they are placed already.
    """
    total, strings = len(text), len(begin) - 1
    size = np.diff(begin)
    owner = np.repeat(np.arange(strings), size)
    order = np.lexsort((text, owner))
    fresh = np.ones(total, bool)
    fresh[1:] = (text[order[1:]] != text[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    heads = np.flatnonzero(fresh)
    array = order.copy()
    place = np.empty(total, np.int64)
    place[array] = np.arange(total)
    group = np.empty(total, np.int64)
    group[array] = np.repeat(heads, np.diff(np.append(heads, total)))
    length = np.zeros(total, np.int64)
    length[heads] = np.diff(np.append(heads, total))
    before = np.full(total, -1, np.int64)

    top = begin[1:] - 1
    live = np.flatnonzero(size > 0)
    while len(live):
        end = top[live]
        head = group[array[end]]
        count = end - head + 1
        members = array[ragged(head, count)]
        own = np.repeat(head, count)
        low = np.repeat(begin[live], count)
        at = members - 1
        todo = np.flatnonzero((at >= low) & (group[np.maximum(at, 0)] > own))
        while len(todo):  # over higher groups, each passed for the last time
            at[todo] = before[at[todo]]
            here = at[todo]
            todo = todo[(here >= low[todo]) & (group[np.maximum(here, 0)] > own[todo])]
        before[members] = at
        todo = np.flatnonzero((at >= low) & (group[np.maximum(at, 0)] == own))
        while len(todo):  # over members of the same group, by doubling: a run of equal characters is one such chain
            at[todo] = before[at[todo]]
            before[members[todo]] = at[todo]
            here = at[todo]
            todo = todo[(here >= low[todo]) & (group[np.maximum(here, 0)] == own[todo])]
        at[at < low] = -1
        before[members] = at
        moved, times = np.unique(at[at >= 0], return_counts=True)
        if len(moved):
            by = np.lexsort((times, group[moved]))
            moved, times = moved[by], times[by]
            old = group[moved]
            first = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            each = np.diff(np.append(first, len(old)))
            zone = old[first] + length[old[first]] - each  # the last places of the group
            target = ragged(zone, each)
            zone = np.repeat(zone, each)
            source = place[moved]
            hole = source[source < zone]
            stay = np.ones(len(target), bool)
            stay[np.searchsorted(target, source[source >= zone])] = False
            evicted = array[target[stay]]
            hole_group = old[source < zone]
            hole = hole[np.argsort(hole_group, kind="stable")]
            array[hole] = evicted
            place[evicted] = hole
            array[target] = moved
            place[moved] = target
            run = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
            widths = np.diff(np.append(run, len(old)))
            length[old[first]] -= each
            length[target[run]] = widths
            group[moved] = np.repeat(target[run], widths)
        top[live] = head - 1
        live = live[top[live] >= begin[live]]

    out = np.full(total, -1, np.int64)
    free = np.arange(total)  # the next place of each group, at its head
    done = np.zeros(total, bool)
    some = np.flatnonzero(size > 0)
    last = begin[some + 1] - 1
    out[begin[some]] = last
    done[last] = True
    for k in range(int(size.max(initial=0))):
        some = some[size[some] > k]
        low = begin[some]
        at = out[low + k] - 1
        while True:
            ok = at >= low
            at, low = at[ok], low[ok]
            ok = ~done[at]
            at, low = at[ok], low[ok]
            if not len(at):
                break
            to = free[group[at]]
            free[group[at]] += 1
            out[to] = at
            done[at] = True
            at = before[at]
    return out
