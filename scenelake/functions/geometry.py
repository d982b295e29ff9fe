"""Boxes, vectors and camera poses as columns. Vectors are arrays of three doubles, matrices of sixteen, by rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import uniform

#: Local axes of an asset: front, back, top. Fixed values.
AXES = {"front_world_normal": (0.0, 0.0, 1.0), "back_world_normal": (0.0, 0.0, -1.0), "top_world_normal": (0.0, 1.0, 0.0)}


def vec(x, y, z) -> Column:
    return F.array(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in (x, y, z)])


def dot(a: Column, b: Column) -> Column:
    return sum((a[i] * b[i] for i in range(1, 3)), a[0] * b[0])


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once and written once into the plan: a transform over one element."""
    return F.get(F.transform(F.array(value), fn), 0)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return let(F.zip_with(a, b, lambda x, y: x - y), length)


def overlap_volume(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Volume shared by two boxes (min, max)."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[1][i], b[1][i]) - F.greatest(a[0][i], b[0][i]))
    return side(0) * side(1) * side(2)


def transform_point(matrix: Column, point: Column) -> Column:
    """4 x 4 matrix times point."""
    row = lambda i: matrix[4 * i] * point[0] + matrix[4 * i + 1] * point[1] + matrix[4 * i + 2] * point[2] + matrix[4 * i + 3]
    return F.array(row(0), row(1), row(2))


def rotate(matrix: Column, axis: tuple[float, float, float]) -> Column:
    """The matrix's upper left 3 x 3 times a vector."""
    row = lambda i: sum((matrix[4 * i + j] * axis[j] for j in range(1, 3)), matrix[4 * i] * axis[0])
    return F.array(row(0), row(1), row(2))


def world_normals(matrix: Column) -> Column:
    return F.struct(*[rotate(matrix, v).alias(k) for k, v in AXES.items()])


def aabb(matrix: Column, corners: Column) -> tuple[Column, Column]:
    """(min, max) of the corners in world space; corners: array of points."""
    world = F.transform(corners, lambda c: transform_point(matrix, c))
    side = lambda pick, i: pick(F.transform(world, lambda c: c[i]))
    return F.array(*[side(F.array_min, i) for i in range(3)]), F.array(*[side(F.array_max, i) for i in range(3)])


def z_extent(matrix: Column, corners: Column) -> Column:
    zs = F.transform(corners, lambda c: transform_point(matrix, c)[2])
    return F.array_max(zs) - F.array_min(zs)


def longest(dx: Column, dy: Column, dz: Column) -> Column:
    return F.greatest(dx, dy, dz)


def longest_axis(dx: Column, dy: Column, dz: Column) -> Column:
    """x, y or z; ties go to the first."""
    m = longest(dx, dy, dz)
    return F.when(dx == m, "x").when(dy == m, "y").otherwise("z")


def rescale(dx: Column, dy: Column, dz: Column, target: Column) -> Column:
    """Factor that makes the longest side the target; 1 for a thing without extent."""
    m = longest(dx, dy, dz)
    return F.when(m > 0, target / m).otherwise(1.0)


def upright(dx: Column, dy: Column, dz: Column, yaw: Column) -> Column:
    """Euler angles that turn the longest side up, with a yaw (-8 to 8 degrees at u = 0 to 1)."""
    axis, turn = longest_axis(dx, dy, dz), uniform(-math.radians(8), math.radians(8), yaw)
    quarter, none = F.lit(math.radians(90)), F.lit(0.0)
    return F.array(F.when(axis == "y", quarter).otherwise(none), F.when(axis == "x", quarter).otherwise(none), turn)


def polar(r: Column, angle: Column) -> tuple[Column, Column]:
    return r * F.cos(angle), r * F.sin(angle)


def orbit(center: Column, radius: Column, u_theta: Column, u_phi: Column, u_r: Column) -> Column:
    """A camera place around a centre: any azimuth, 10 to 35 degrees up, 1.2 to 1.8 radii away."""
    theta = uniform(0.0, 2 * math.pi, u_theta)
    phi = uniform(math.radians(10), math.radians(35), u_phi)
    r = radius * uniform(1.2, 1.8, u_r)
    return F.array(
        center[0] + r * F.cos(theta) * F.cos(phi), center[1] + r * F.sin(theta) * F.cos(phi), center[2] + r * F.sin(phi)
    )


def look_at_basis(location: Column, target: Column) -> Column:
    """Right, up and backward axes of a camera at location that looks at target, world z being up: array of nine.

    Straight up or down, right is the world's x. Angles depend on a tool's conventions; the basis does not.
    """

    def axes(b: Column, flat: Column) -> Column:
        steep = flat < 1e-12
        right = F.array(F.when(steep, 1.0).otherwise(-b[1] / flat), F.when(steep, 0.0).otherwise(b[0] / flat))
        return let(right, lambda r: F.array(r[0], r[1], F.lit(0.0), -b[2] * r[1], b[2] * r[0], b[0] * r[1] - b[1] * r[0], b[0], b[1], b[2]))

    unit = lambda v: let(length(v), lambda n: F.when(n > 0, F.transform(v, lambda c: c / n)).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    back = let(F.zip_with(location, target, lambda x, y: x - y), unit)
    return let(back, lambda b: let(F.sqrt(b[0] * b[0] + b[1] * b[1]), lambda flat: axes(b, flat)))


def euler_basis(angles: Column) -> Column:
    """Right, up and backward axes of a camera turned about x, then y, then z by angles in radians: array of nine, as
    look_at_basis; an unturned camera looks down with y up."""

    def axes(c: Column, s: Column) -> Column:
        return F.array(
            c[1] * c[2], c[1] * s[2], -s[1],
            s[0] * s[1] * c[2] - c[0] * s[2], s[0] * s[1] * s[2] + c[0] * c[2], s[0] * c[1],
            c[0] * s[1] * c[2] + s[0] * s[2], c[0] * s[1] * s[2] - s[0] * c[2], c[0] * c[1],
        )

    cos, sin = F.transform(angles, lambda a: F.cos(a)), F.transform(angles, lambda a: F.sin(a))
    return F.when(angles.isNotNull(), let(cos, lambda c: let(sin, lambda s: axes(c, s))))


def basis_euler(basis: Column) -> Column:
    """The angles about x, y and z, in radians, whose euler_basis is the basis; y lies within a quarter turn.

    Where the right axis points straight up or down only the sum of the other two is fixed, and z is 0.
    """

    def angles(b: Column, flat: Column) -> Column:
        fixed = flat < 1e-6
        x = F.when(fixed, F.atan2(-b[7], b[4])).otherwise(F.atan2(b[5], b[8]))
        return F.array(x, F.atan2(-b[2], flat), F.when(fixed, 0.0).otherwise(F.atan2(b[1], b[0])))

    return let(basis, lambda b: let(F.sqrt(b[0] * b[0] + b[1] * b[1]), lambda flat: angles(b, flat)))


def quantise(x: Column, places: int = 6) -> Column:
    """Rounded by floor(x + 1/2), the same in every SQL engine."""
    f = 10.0**places
    return F.floor(x * f + 0.5) / f
