"""Framework recognizers, and one bridge across languages from source text to impact."""

from archgraph.operators import graph, resolve
from archgraph.sources import frameworks, languages, protobuf

SERVER = """
mod pb { tonic::include_proto!("pricing.v1"); }
struct Svc;
impl pb::pricing_server::Pricing for Svc { async fn get_price(&self) -> u8 { 1 } }
"""
ELIXIR = """
defmodule Pricing.V1.Pricing.Service do
  use GRPC.Service, name: "pricing.v1.Pricing", protoc_gen_elixir_version: "0.1"
  rpc :GetPrice, A, B
end
defmodule Shop.Prices do
  def fetch(channel) do
    Pricing.V1.Pricing.Stub.get_price(channel, 1)
  end
end
"""


def grpc(rows):
    return {(r["local_symbol"], r["role"], r["service"], r["method"]) for r in rows if r["sort"] == "grpc"}


def test_tonic():
    assert grpc(frameworks.rust_tonic(SERVER, "srv", "src/main.rs")) == {("repo://srv/rust/main/impl/Pricing-for-Svc/get_price", "server", "pricing.v1.Pricing", "GetPrice")}
    client = 'tonic::include_proto!("pricing.v1");\nasync fn run() { let mut c = PricingClient::connect("http://x").await; c.get_price(1).await; }'
    assert grpc(frameworks.rust_tonic(client, "c", "src/c.rs")) == {("repo://c/rust/c/run", "client", "pricing.v1.Pricing", "GetPrice")}
    assert frameworks.rust_tonic(client.replace("tonic::include_proto", "// "), "c", "c.rs")[0]["service"] == "rust.tonic_package_unresolved"
    assert frameworks.rust_tonic("fn a() {}", "c", "c.rs") == []


def test_nestjs_and_absinthe():
    text = """
    @Resolver(() => Cart) export class CartResolver {
      @GrpcMethod('Pricing', 'GetPrice') getPrice(x) { return 1; }
      @Query(() => Cart, { name: 'checkout' }) async find() { return 1; }
      @ResolveField(() => Int) total() { return this.svc.watchPrice({}); }
      onModuleInit() { this.svc = this.client.getService<PricingClient>('Pricing'); }
    }"""
    rows = frameworks.nestjs(text, "r", "a.ts")
    base = "repo://r/typescript/a.ts/CartResolver"
    assert grpc(rows) == {(f"{base}/getPrice", "server", "Pricing", "GetPrice"), (f"{base}/total", "client", "Pricing", "WatchPrice")}
    assert {(r["field"], r["parent"], r["target"]) for r in rows if r["sort"] == "resolver"} == {("checkout", "Query", f"{base}/find"), ("total", "Cart", f"{base}/total")}
    schema = "query do\n  field :check_out, :cart do\n    resolve &Shop.Carts.find/3\n  end\nend\nobject :cart do\n  field :total, :integer, resolve: fn -> 1 end\nend"
    (row,) = frameworks.elixir_absinthe(schema, "r", "s.ex")
    assert (row["field"], row["parent"], row["target"]) == ("checkOut", "Query", "repo://r/elixir/Shop.Carts/find/3")


def test_registrations_and_lifecycle():
    assert [(r["service"], r["target"]) for r in frameworks.dotnet_di("services.AddScoped<App.IStore, Store>(); // .AddScoped<A, B>()", "r", "p.cs")] == [("IStore", "Store")]
    rows = frameworks.unity_lifecycle("public class P : MonoBehaviour {\n IEnumerator Start() { }\n int Update() { }\n void Awake(int x) { }\n void OnTriggerEnter() { } }", "r", "P.cs")
    assert [(r["sort"], r["parent"], r["method"] if "method" in r else None, r["target"]) for r in rows] == [("base", "P", None, "MonoBehaviour"), ("lifecycle", "P", "Start", "repo://r/csharp/default/P.cs/P/Start()")]


def test_bridge_from_elixir_to_rust(spark):
    proto = 'syntax = "proto3"; package pricing.v1; message P {} service Pricing { rpc GetPrice (P) returns (P); }'
    rows = [("srv", "src/main.rs", SERVER), ("shop", "lib/s.ex", ELIXIR), ("srv", "p.proto", proto)]
    files = spark.createDataFrame([(r, p, bytearray(t.encode())) for r, p, t in rows], "repository string, path string, content binary")
    contracts = protobuf.proto_sources(files)
    candidates = frameworks.grpc_candidates(frameworks.recognize(files), protobuf.contract_methods(contracts))
    _, edges, unmatched = resolve.resolve_grpc(candidates, protobuf.contract_methods(contracts))
    assert unmatched.collect() == []
    found = graph.impact(graph.Graph(languages.edges(languages.analyze(files)), None, edges), "proto-method://pricing.v1.Pricing/GetPrice")
    hops = {r.entity: r.hops for r in found.entries.collect()}
    assert hops["repo://shop/elixir/Shop.Prices/fetch/1"] == 2 and hops["repo://srv/rust/main/impl/Pricing-for-Svc/get_price"] == 2
