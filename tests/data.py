"""Small training tables with known answers."""

from __future__ import annotations

# Public NIST StRD data sets and Anscombe's quartet.
NORRIS = [
    (0.1, 0.2), (338.8, 337.4), (118.1, 118.2), (888, 884.6), (9.2, 10.1), (228.1, 226.5), (668.5, 666.3), (998.5, 996.3), (449.1, 448.6), (778.9, 777), (559.2, 558.2), (0.3, 0.4),
    (0.1, 0.6), (778.1, 775.5), (668.8, 666.9), (339.3, 338), (448.9, 447.5), (10.8, 11.6), (557.7, 556), (228.3, 228.1), (998, 995.8), (888.8, 887.6), (119.6, 120.2), (0.3, 0.3),
    (0.6, 0.3), (557.6, 556.8), (339.3, 339.1), (888, 887.2), (998.5, 999), (778.9, 779), (10.2, 11.1), (117.6, 118.3), (228.9, 229.2), (668.4, 669.1), (449.2, 448.9), (0.2, 0.5),
]
NORRIS_FIT = (-0.262323073774029, 1.00211681802045)
NORRIS_SD, NORRIS_R2 = 0.884796396144373, 0.999993745883712

LONGLEY = [
    (60323, 83, 234289, 2356, 1590, 107608, 1947), (61122, 88.5, 259426, 2325, 1456, 108632, 1948), (60171, 88.2, 258054, 3682, 1616, 109773, 1949), (61187, 89.5, 284599, 3351, 1650, 110929, 1950),
    (63221, 96.2, 328975, 2099, 3099, 112075, 1951), (63639, 98.1, 346999, 1932, 3594, 113270, 1952), (64989, 99, 365385, 1870, 3547, 115094, 1953), (63761, 100, 363112, 3578, 3350, 116219, 1954),
    (66019, 101.2, 397469, 2904, 3048, 117388, 1955), (67857, 104.6, 419180, 2822, 2857, 118734, 1956), (68169, 108.4, 442769, 2936, 2798, 120445, 1957), (66513, 110.8, 444546, 4681, 2637, 121950, 1958),
    (68655, 112.6, 482704, 3813, 2552, 123366, 1959), (69564, 114.2, 502601, 3931, 2514, 125368, 1960), (69331, 115.7, 518173, 4806, 2572, 127852, 1961), (70551, 116.9, 554894, 4007, 2827, 130081, 1962),
]
LONGLEY_FIT = (-3482258.63459582, 15.0618722713733, -0.0358191792925910, -2.02022980381683, -1.03322686717359, -0.0511041056535807, 1829.15146461355)
LONGLEY_SD, LONGLEY_R2 = 304.854073561965, 0.995479004577296

ANSCOMBE_X = [10, 8, 13, 9, 11, 14, 6, 4, 12, 7, 5]
ANSCOMBE = {
    "I": (ANSCOMBE_X, [8.04, 6.95, 7.58, 8.81, 8.33, 9.96, 7.24, 4.26, 10.84, 4.82, 5.68]),
    "II": (ANSCOMBE_X, [9.14, 8.14, 8.74, 8.77, 9.26, 8.1, 6.13, 3.1, 9.13, 7.26, 4.74]),
    "III": (ANSCOMBE_X, [7.46, 6.77, 12.74, 7.11, 7.81, 8.84, 6.08, 5.39, 8.15, 6.42, 5.73]),
    "IV": ([8] * 7 + [19] + [8] * 3, [6.58, 5.76, 7.71, 8.84, 8.47, 7.04, 5.25, 12.5, 5.56, 7.91, 6.89]),
}

TRIPS = [(0, 0), (10, 0), (0, 3), (10, 3), (5, 1), (20, 2)]
ROUTES = [(g, float(a + b * km + c * stops), float(km), float(stops)) for g, a, b, c in (("city", 5, 3, 2), ("suburb", 4, 2, 1.5), ("highway", 8, 1, 5)) for km, stops in TRIPS]
WAMPLER = [("A", float(sum(x**k for k in range(6))), *[float(x**k) for k in range(1, 6)]) for x in range(21)]
CLOSE = [("A", 1 + 2 * (1 + 0.01 * i) + 3 * (1 + 0.01 * i + 1e-6 * (i % 2)), 1 + 0.01 * i, 1 + 0.01 * i + 1e-6 * (i % 2)) for i in range(40)]
