"""A PHP corpus of any size, made from one template, to measure throughput with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS = r'''<?php

namespace App\Module@N@;

use App\Contracts\Repository;

/**
 * Reads and writes records of one kind.
 */
final class Store@N@ extends Base implements Repository
{
    const LIMIT = 100;

    private array $items = [];

    public function __construct(array $items = [])
    {
        parent::__construct();
        $this->items = $items;
    }

    /**
     * @param int $id
     * @return string|null
     */
    public function find(int $id): ?string
    {
        if (!isset($this->items[$id])) {
            return null;
        }
        $name = trim($this->items[$id]);
        foreach ($this->items as $key => $value) {
            if ($key === $id) {
                continue;
            }
            $name .= " {$value}";
        }
        switch (strlen($name)) {
            case 0:
                return null;
            case 1:
                $name = $name . '!';
                break;
            default:
                $name = ucfirst($name);
        }
        return $name;
    }

    public function total(): int
    {
        $sum = 0;
        for ($i = 0; $i < count($this->items); $i++) {
            $sum += $this->items[$i] ?? @N@;
        }
        try {
            $sum = $this->check($sum) ? $sum : 0;
        } catch (\RuntimeException $e) {
            $sum = -1;
        }
        return $sum;
    }
}
'''


def corpus(spark: SparkSession, lines: int) -> DataFrame:
    """(path, content) of files with about so many lines in all."""
    n = max(1, lines // CLASS.count("\n"))
    text = F.replace(F.lit(CLASS), F.lit("@N@"), F.col("id").cast("string"))
    return spark.range(n).select(F.format_string("src/Store%d.php", "id").alias("path"), text.alias("content"))
