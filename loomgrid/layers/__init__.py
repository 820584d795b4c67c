"""Graph layers and recurrent cells as plans over neighbour aggregations, with given weights."""
