"""placegraph: places, polygons, walking networks, timetables and activity on Spark."""

__version__ = "0.1.0"
