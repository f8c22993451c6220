"""Operators against their definitions on generated purchases."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from tideline.operators.cohorts import cohort_matrix
from tideline.operators.funnel import acquisition_funnel, activation


def plus_months(day, months):
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def generated(seed, customers=300):
    pick = random.Random(seed)
    rows = []
    for customer in range(customers):
        start = dt.datetime(2019, 10, 1) + dt.timedelta(days=pick.randrange(200))
        for _ in range(pick.choice([1, 1, 2, 3, 5, 9])):
            gap = pick.choice([0, 0, 1, 29, 30, 31, 32, 59, 60, 89, 90, 91, 92, 93, 120, 400])
            at = start + dt.timedelta(days=gap, seconds=pick.randrange(86400))
            rows.append((customer, str(at)))
        rows.append((customer, str(start)))
    return rows


def days_of(rows):
    days = defaultdict(set)
    for customer, at in rows:
        days[customer].add(dt.date.fromisoformat(at[:10]))
    return {customer: sorted(found) for customer, found in days.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_funnel_equals_the_definition(purchases, seed):
    rows = generated(seed)
    activated, retained = {}, 0
    for customer, days in days_of(rows).items():
        first = days[0]
        activated[customer] = int(len(days) > 1 and (days[1] - first).days <= 30)
        later = [d for d in days if (d - first).days > 30 and d <= plus_months(first, 3)]
        retained += bool(activated[customer] and later)
    frame = purchases(*rows)
    assert {r.customer_id: r.activated for r in activation(frame).collect()} == activated
    assert tuple(acquisition_funnel(frame).first())[:3] == (300, sum(activated.values()), retained)


@pytest.mark.parametrize("seed", [4, 5])
def test_cohorts_equal_the_definition(purchases, seed):
    rows = generated(seed)
    size, active = defaultdict(int), defaultdict(int)
    for days in days_of(rows).values():
        months = {day.replace(day=1) for day in days}
        cohort = min(months)
        size[cohort] += 1
        for month in months:
            active[cohort, (month.year - cohort.year) * 12 + month.month - cohort.month] += 1
    expected = [(cohort, k, size[cohort], n) for (cohort, k), n in sorted(active.items())]
    assert [tuple(row)[:4] for row in cohort_matrix(purchases(*rows)).collect()] == expected
