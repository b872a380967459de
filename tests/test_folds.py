"""Folds that come from the calendar of the data."""

from tideframe.operators import learn


def test_month_folds_test_every_month_after_the_first_training_span():
    folds = learn.month_folds(199511, 200002, train_months=12, purge=1)
    months = [y * 100 + m for y in range(1995, 2001) for m in range(1, 13) if 199511 <= y * 100 + m <= 200002]
    assert [f[1] for f in folds] == months[13:]
    for train_to, test_from, test_to in folds:
        k = months.index(test_from)
        assert train_to == months[k - 1] and (test_to == months[k + 1] if k + 1 < len(months) else test_to == 200003)
    assert learn.month_folds(199901, 199906) == []
