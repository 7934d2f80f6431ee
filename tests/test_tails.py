import numpy as np
import pytest

from gridols.functions.special import minus_log10, t_sf

#: T and -log10 of the tail above it, integrated from the density in 40-digit arithmetic; many degrees of freedom, far out.
TAILS = [(40248, 6.630848408986595, 10.772145919884476), (40639, 6.323457093331822, 9.888691249670982), (40416, 9.76332274964497, 22.06726103525972), (40470, 6.02142398586691, 9.059545069788944)]


@pytest.mark.parametrize("df, t, want", TAILS)
def test_far_tails_of_many_degrees_of_freedom(df, t, want):
    assert minus_log10(t_sf(t, df), -323.3) == pytest.approx(want, abs=1e-7)
    assert t_sf(-t, df) == pytest.approx(1 - 10**-want, abs=1e-15)
    assert np.isfinite(minus_log10(t_sf(t, df), -323.3))
