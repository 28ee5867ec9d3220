"""Analytics over points with coordinates, attributes and a sparse feature matrix, on Spark data frames."""
