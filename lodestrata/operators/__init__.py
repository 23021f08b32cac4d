"""DataFrame operators on surveys, models and meshes."""
