"""Hand-made meshes with known answers."""

from tessera.model import Mesh

FACES = "mesh_id long, fid long, vids array<long>"
POINTS = "mesh_id long, vid long, x double, y double, z double"


def mesh(spark, points, faces, key=0):
    p = [(key, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(points)]
    f = [(key, i, list(v)) for i, v in enumerate(faces)]
    return Mesh(spark.createDataFrame(f, FACES), spark.createDataFrame(p, POINTS))


def flat(points):
    return [(x, y, 0) for x, y in points]


#: name: points, faces
#: Three triangles around a corner of a house; area 8.
HOUSE = (flat([(0, 0), (3, 0), (3, 2), (1.5, 4), (0, 2)]), [(0, 1, 2), (0, 2, 3), (0, 3, 4)])
#: Closed; volume 4 / 3.
OCTA = ([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)])
#: Four faces on one edge.
BOOK = ([(0, 0, 0), (0, 0, 3), (2, 0, 1), (0, 2, 1), (-2, 0, 1), (0, -2, 2)], [(0, 1, 2), (0, 1, 3), (1, 0, 4), (0, 1, 5)])
#: Two quads that don't touch.
APART = (flat([(0, 0), (2, 0), (2, 1), (0, 1), (7, 7), (9, 7), (9, 8), (7, 8)]), [(0, 1, 2, 3), (4, 5, 6, 7)])
#: A pentagon and a triangle on one of its sides.
MIXED = (flat([(0, 0), (4, 0), (5, 3), (2, 5), (-1, 3), (7, 1)]), [(0, 1, 2, 3, 4), (1, 5, 2)])
#: A house whose middle face runs the other way.
TURNED = (HOUSE[0], [(0, 1, 2), (0, 3, 2), (0, 3, 4)])
HOLE = (
    flat([(0, 0), (2, 0), (2, 2), (0, 2), (0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]),
    [(0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)],
)
