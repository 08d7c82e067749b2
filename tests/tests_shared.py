"""Plain Python versions that several test modules compare with."""

import math


def straighten_at(points):
    """Places of the vertices that the collinear rule keeps."""
    if len(points) < 3:
        return list(range(len(points)))
    out = [0]
    for i in range(1, len(points) - 1):
        (ax, ay), p, q = points[out[-1]], points[i], points[i + 1]
        u, v = (p[0] - ax, p[1] - ay), (q[0] - p[0], q[1] - p[1])
        n1, n2 = math.sqrt(u[0] ** 2 + u[1] ** 2), math.sqrt(v[0] ** 2 + v[1] ** 2)
        if n1 >= 1e-9 and n2 >= 1e-9 and (u[0] * v[0] + u[1] * v[1]) / (n1 * n2) < 0.998:
            out.append(i)
    return [*out, len(points) - 1]
