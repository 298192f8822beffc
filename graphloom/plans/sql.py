"""The same answers in DuckDB SQL, by other means: recursion over the raw tables."""

PS = """e as materialized (select row_number() over (order by k, u, v, w) e, u, v, w from (select l_orderkey*10+l_linenumber k, 2*l_partkey u, 2*l_suppkey+1 v, l_linenumber::bigint w from lineitem))"""
CP = """e as materialized (select row_number() over (order by k, u, v, w) e, u, v, w from (select l_orderkey*10+l_linenumber k, 2*o_custkey u, 2*l_partkey+1 v, l_quantity::bigint w from lineitem join orders on l_orderkey=o_orderkey))"""
OP = """e as materialized (select row_number() over (order by k, u, v, w) e, u, v, w from (select l_orderkey*10+l_linenumber k, 2*l_orderkey u, 2*l_partkey+1 v, l_linenumber::bigint w from lineitem))"""
CC = """a as materialized (select u s, v d, e from e union all select v, u, e from e),
cc(v,comp) using key (v) as (
  select distinct s, s from a
  union
  select a.d, min(cc.comp) from cc join a on a.s=cc.v join recurring.cc r on r.v=a.d where cc.comp<r.comp group by a.d)"""
BFS = CC + """,
bfs(v,lvl) using key (v) as (
  select v,0 from cc where v=comp
  union
  select a.d, min(bfs.lvl)+1 from bfs join a on a.s=bfs.v left join recurring.bfs r on r.v=a.d where r.v is null group by a.d),
par as materialized (select d v, arg_min(s,(s,e)) p, arg_min(e,(s,e)) te, any_value(b.lvl) lvl
        from a join bfs b on b.v=a.d join bfs bp on bp.v=a.s where bp.lvl=b.lvl-1 group by d),
climb(x,y) as (
  select u,v from e where e not in (select te from par)
  union
  select case when coalesce(px.lvl,0)>=coalesce(py.lvl,0) then px.p else x end, case when coalesce(py.lvl,0)>=coalesce(px.lvl,0) then py.p else y end
  from climb left join par px on px.v=x left join par py on py.v=y where x<>y),
low as materialized (select distinct case when coalesce(px.lvl,0)>=coalesce(py.lvl,0) then x end z from climb left join par px on px.v=x left join par py on py.v=y where x<>y
  union select case when coalesce(py.lvl,0)>=coalesce(px.lvl,0) then y end from climb left join par px on px.v=x left join par py on py.v=y where x<>y),
br as materialized (select te e from par where v not in (select z from low where z is not null))"""
BLOCKS = BFS + """,
k as materialized (select s,d from a where e not in (select e from br)),
bb(v,blk) using key (v) as (
  select v, v from cc
  union
  select k.d, min(bb.blk) from bb join k on k.s=bb.v join recurring.bb r on r.v=k.d where bb.blk<r.blk group by k.d)"""
PAIRS = "q as (select p_partkey qid, 2*p_partkey u, 2*((p_partkey*37) % (select max(p_partkey) from part)+1) v from part)"
#: The hierarchy: customers (3), nations (2), regions (1); pairs of customers and the two to four edges between them.
H = """he as materialized (select n_nationkey+2000000000000 e, n_nationkey+2000000000000 u, n_regionkey+1000000000000 v, (n_nationkey+1)::bigint w from nation union all select c_custkey+3000000000000, c_custkey+3000000000000, c_nationkey+2000000000000, (c_custkey%97+1)::bigint from customer),
hq as (select c_custkey qid, c_custkey+3000000000000 u, (c_custkey*37) % (select max(c_custkey) from customer)+1+3000000000000 v from customer),
hs as materialized (
  select qid, unnest(case when q.u=q.v then [] when x.v=y.v then [x.e, y.e] when nx.v=ny.v then [x.e, nx.e, ny.e, y.e] else [] end) e,
    generate_subscripts(case when q.u=q.v then [] when x.v=y.v then [x.e, y.e] when nx.v=ny.v then [x.e, nx.e, ny.e, y.e] else [] end, 1) pos
  from hq q join he x on x.e=q.u join he y on y.e=q.v join he nx on nx.e=x.v join he ny on ny.e=y.v)"""
#: Cover levels by rule, parts of the levels 0..2, and vertices on each path.
HC = H + """,
hc as materialized (select *, case when e>=3000000000000 then e%4-1 else 1 end c from he),
pt as materialized (
  select l, u x, case when c.c>=l then case when n.c>=l then n.v else c.v end else c.u end part from hc c join (select e, v, c from hc where e<3000000000000) n on n.e=c.v, (values (0),(1),(2)) t(l)
  union all select l, u, case when c>=l then v else u end from hc, (values (0),(1),(2)) t(l) where e<3000000000000
  union all select l, r_regionkey+1000000000000, r_regionkey+1000000000000 from region, (values (0),(1),(2)) t(l)),
hv as materialized (
  select distinct qid, x from (
    select qid, u x from hs join he using(e) union all select qid, v from hs join he using(e) union all select qid, u from hq where u=v)),
lab as (select c_custkey id, c_custkey+3000000000000 x, c_custkey%3 l from customer where c_acctbal>0)"""
#: Pairs of orders.
OPAIRS = "q as (select o_orderkey qid, 2*o_orderkey u, 2*((o_orderkey*37) % (select max(o_orderkey) from orders)+1) v from orders)"
#: Kruskal as a fold: the state is the label of every vertex, then 0, then the edges taken.
KRUSKAL = """vs as materialized (select x, row_number() over (order by x) i from (select u x from e union select v from e)),
el as (select list([a.i, b.i, f.e] order by f.e) l, (select count(*) from vs) n from (select min(e) e, u, v from e group by u, v) f join vs a on a.x=f.u join vs b on b.x=f.v),
kr as (select list_reduce(list_prepend(list_concat(range(1, n+1), [0::bigint]), l), lambda s, t: case when s[t[1]]=s[t[2]] then s
  else list_append(list_transform(s, lambda y, j: case when j<=n and y=s[t[2]] then s[t[1]] else y end), t[3]) end) s, n from el),
tr as materialized (select unnest(s[n+2:]) e from kr)"""
LOG = """lo as materialized (select event_id seq, case event_type when 'error' then 'remove_edge' when 'signup' then 'remove_vertex' else 'link' end op, case when event_type='error' then event_id*7//8 else event_id end eid,
  case when event_type='signup' then event_id%9973+100 else (event_id*31+user_id)%2003 end u, (event_id*17)%1999 v from events),
vb as (select x, min(seq) born from (select u x, seq from lo where op='link' union all select v, seq from lo where op='link') group by 1),
vl as materialized (select x, born, coalesce(min(r.seq), 9223372036854775807) dies from vb left join lo r on r.op='remove_vertex' and r.u=vb.x and r.seq>born group by 1,2),
ct as (select l.eid, min(r.seq) cut from lo l join lo r on r.eid=l.eid where l.op='link' and r.op='remove_edge' and r.seq>l.seq group by 1),
el as materialized (select l.eid, l.u, l.v, l.seq born, least(coalesce(cut, 9223372036854775807), a.dies, b.dies) dies from lo l join vl a on a.x=l.u join vl b on b.x=l.v left join ct on ct.eid=l.eid where op='link' and l.u<>l.v and least(a.dies, b.dies)>l.seq)"""
#: Both directions of living edges.
SIDES = "sd as materialized (select u s, v d, eid, born, dies from el union all select v, u, eid, born, dies from el)"
KV = "kv as materialized (select event_id k, floor(value*100)::bigint v from events), ask as (select k+100 k from kv)"
#: The log of labels and the part-supplier graph with all its vertices.
LABELS = """ll as (select c_custkey k, unnest([0,1,2,3,4]) p from customer),
lg as (select k*5+p seq, case p when 0 then 'detach' when 1 then 'attach' when 3 then 'detach' else 'update_label' end op, k, k*10+p w from ll where p=1 or (p=0 and k%7=0) or (p=2 and k%3=0) or (p=3 and k%5=0) or (p=4 and k%6=0)),
lv as materialized (select k, (select arg_max(w, seq) from lg x where x.k=lg.k and x.op<>'detach') w from lg where op='attach' and k%5<>0)"""
OLD = "ol as materialized (select c_custkey id, c_custkey+3000000000000 x, c_custkey%3 l, c_custkey%13 w from customer where c_acctbal>0)"
ALLV = "av as materialized (select u x from e union select v from e union select 2*p_partkey from part union select 2*s_suppkey+1 from supplier union select 2*p_partkey+10000000 from part)"
NEW = "nw as (select p_partkey+1000000000 e, 2*p_partkey u, case when p_partkey%10=0 then 2*p_partkey else 2*(p_partkey%150)+1 end v from part)"


def _r(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


TAG = "list_reduce(list_prepend(-1, list(%s order by seq)), lambda x, t: case when t >= 100 then case when x <= t-100 then -1 else x end else greatest(x, t) end)"

SQL = {
    "bridges": _r(OP, BFS, "select e.e edge_id, e.u, e.v, comp component_id, n component_size from br join e using(e) join cc on cc.v=u join (select comp, count(*) n from cc group by 1) using(comp)"),
    "edges": _r(PS, "select e edge_id, u, v, w weight from e"),
    "edges_endpoints": _r(PS, "select p_partkey*41 edge_id, u, v from part left join e on e=p_partkey*41"),
    "degree": _r(PS, "select x vertex_id, count(*) degree from (select u x from e union all select v from e) group by 1"),
    "parallel_pairs": _r(PS, "select least(u,v) u, greatest(u,v) v, count(*) copies, min(e) first_edge from e group by 1,2 having count(*)>1"),
    "find_edge_by_endpoints": _r(PS, "select v u, u v, min(e) edge_id from e group by 1,2"),
    "connected_pairs": _r(OP, CC, OPAIRS, "select qid, coalesce(x.comp=y.comp, false) connected from q left join cc x on x.v=q.u left join cc y on y.v=q.v"),
    "component_size": _r(OP, CC, "select v vertex_id, comp component_id, count(*) over (partition by comp) size from cc"),
    "component_of": _r(OP, CC, "select comp component_id, v as member from cc"),
    "tree_edge_count": _r(CP, CC, "select count(*)-count(distinct comp) tree_edges from cc"),
    "spanning_forest_msf": _r(PS, KRUSKAL, BFS, "select e.e edge_id, tr.e is not null is_tree, case when br.e is not null then -1 else 0 end as level from e left join tr on tr.e=e.e left join br on br.e=e.e"),
    "incident_edges": _r(PS, KRUSKAL, "nt as materialized (select * from e where e not in (select e from tr))", "select u vertex_id, e edge_id from nt union all select v, e from nt"),
    "is_bridge": _r(OP, BFS, "select e edge_id, e in (select e from br) is_bridge from e"),
    "find_bridge_vertex": _r(OP, BFS, "select cc.v vertex_id, x.b bridge from cc left join (select comp, min(br.e) b from br join e using(e) join cc on cc.v=e.u group by 1) x using(comp)"),
    "two_edge_components": _r(OP, BLOCKS, "select v vertex_id, blk block, count(*) over (partition by blk) size from bb"),
    "two_edge_connected_pairs": _r(OP, BLOCKS, OPAIRS, "select qid, coalesce(x.blk=y.blk, false) two_edge_connected from q left join bb x on x.v=q.u left join bb y on y.v=q.v"),
    "find_bridge_between": _r(OP, BFS, OPAIRS, """w(qid,x,y,t) as (
  select qid, q.u, q.v, null::bigint from q join cc x on x.v=q.u join cc y on y.v=q.v where x.comp=y.comp and q.u<>q.v
  union all
  select qid, case when coalesce(px.lvl,0)>=coalesce(py.lvl,0) then px.p else x end, case when coalesce(px.lvl,0)>=coalesce(py.lvl,0) then y else py.p end, case when coalesce(px.lvl,0)>=coalesce(py.lvl,0) then px.te else py.te end
  from w left join par px on px.v=x left join par py on py.v=y where x<>y)""",
        "select q.qid, min(br.e) bridge, case when count(w.t)=0 then 2147483647 when count(br.e)>0 then -1 else 0 end::int cover_level from q left join w on w.qid=q.qid left join br on br.e=w.t group by 1"),
    "cover_level_component": _r(OP, BFS, "select comp component_id, case when min(br.e) is null then 0 else -1 end::int cover_level, min(br.e) min_edge from cc left join e on e.u=cc.v left join br using(e) group by 1"),
    "min_covered_edge_between": _r(HC, "select hq.qid, coalesce(min(c), 2147483647)::int cover_level, arg_min(hc.e, (c, hc.e)) min_edge from hq left join hs using(qid) left join hc on hc.e=hs.e group by 1"),
    "path_len_sum_max": _r(H, "select hq.qid, case when any_value(hq.u)=any_value(hq.v) then 0 else nullif(count(hs.e),0) end path_len, case when any_value(hq.u)=any_value(hq.v) then 0 else sum(w) end::bigint path_sum, case when any_value(hq.u)=any_value(hq.v) then 0 else max(w) end path_max from hq left join hs using(qid) left join he on he.e=hs.e group by 1"),
    "path_edges_ordered": _r(H, "select hq.qid, string_agg(e::varchar, ',' order by pos) edges from hq left join hs using(qid) group by 1"),
    "path_user_fold": _r(H, "select qid, list_reduce(list_prepend(0::bigint, list(w order by pos)), lambda a, x: (a*31+x)%1000003) as value from hs join he using(e) group by 1"),
    "component_fold": _r(H, """t as (select n_regionkey+1000000000000 k, w from he join nation on e=n_nationkey+2000000000000 union all select n_regionkey+1000000000000, w from he join customer on e=c_custkey+3000000000000 join nation on n_nationkey=c_nationkey
  union all select n_regionkey+1000000000000, c_custkey%13 from customer join nation on n_nationkey=c_nationkey where c_acctbal>0)""", "select k component_id, count(*) n, sum(w)::bigint total, bit_xor(w) xored, min(w) least, max(w) most from t group by 1"),
    "find_size_levels": _r(HC, """n as (select l, part, count(*) n from pt group by 1,2), m as (select distinct hv.qid, pt.l, part from hv join pt on pt.x=hv.x and pt.l=hv.qid%3)""", "select hq.qid, coalesce(sum(n.n),0)::bigint size from hq left join m using(qid) left join n on n.l=m.l and n.part=m.part group by 1"),
    "find_first_label": _r(HC, """m as (select distinct hv.qid, pt.l, part from hv join pt on pt.x=hv.x and pt.l=hv.qid%3),
cand as (select m.qid, lab.id, lab.x from m join pt on pt.l=m.l and pt.part=m.part join lab on lab.x=pt.x and lab.l=m.l),
ch as materialized (select c.u x, [c.u, c.v, n.v] up from he c join he n on n.e=c.v),
ord as materialized (select qid, x, min(pos) pos from (select qid, case when pos<=n/2 then u else v end x, pos-1 pos from hs join he using(e) join (select qid, count(*) n from hs group by 1) using(qid) union all select qid, case when pos<=n/2 then v else u end, pos from hs join he using(e) join (select qid, count(*) n from hs group by 1) using(qid) union all select qid, u, 0 from hq where u=v) group by 1,2),
way as (select cand.qid, cand.id, cand.x, unnest(case when cu.up[1]=cx.up[1] then [cx.up[1]] when cu.up[2]=cx.up[2] then [cx.up[1], cx.up[2], cu.up[1]] else [cx.up[1], cx.up[2], cx.up[3], cu.up[2], cu.up[1]] end) y from cand join hq using(qid) join ch cu on cu.x=hq.u join ch cx on cx.x=cand.x),
ds as (select way.qid, id, way.x, max(pos) dist from way join ord on ord.qid=way.qid and ord.x=way.y group by 1,2,3)""", "select hq.qid, arg_min(id, (dist, x, id)) label_id from hq left join ds using(qid) group by 1"),
    "incident_mask": _r(HC, """m as (select distinct hv.qid, pt.l, part from hv join pt on pt.x=hv.x)""", "select hq.qid, coalesce(bit_or(1::bigint << (lab.l+1)),0)::bigint mask from hq left join m using(qid) left join pt on pt.l=m.l and pt.part=m.part left join lab on lab.x=pt.x and lab.l=pt.l group by 1"),
    "cover_uncover_fold": _r(H, "t as (select e, " + TAG % "case when qid%3=0 then 100+qid%5 else qid%5 end" + " x from (select e, qid, qid seq from hs) group by 1)", "select he.e edge_id, coalesce(x,-1)::int cover_level from he left join t using(e)"),
    "path_tag_add": _r(H, "select he.e edge_id, (any_value(w)+coalesce(sum(qid%11),0))::bigint weight from he left join hs using(e) group by 1"),
    "level_algebra": "select l::int as level, case when l between -1 and 32 then l end::int as valid, case when l between -1 and 31 then l+1 end::int as following, case when l<=9 then -1 else l end::int as covered_then_not, greatest(l,-1)::int as same, 32 as top from range(-4,40) t(l)",
    "range_aggregate_bounds": """with k as (select * from (values (0,'included'),(1,'excluded'),(2,'unbounded')) t(i,n)), u as (select distinct user_id from events),
r as (select (user_id*9+a.i*3+b.i)::bigint rid, user_id*40 lo, a.n lk, user_id*60-100 hi, b.n hk from u, k a, k b)
select rid, coalesce(sum(floor(value*100)::bigint),0)::bigint total, count(event_id) n from r left join events on (lk='unbounded' or event_id>lo or (lk='included' and event_id=lo)) and (hk='unbounded' or event_id<hi or (hk='included' and event_id=hi)) group by 1""",
    "range_scan": "with m as (select min(event_id) lo, max(event_id) hi from events) select event_id as key, floor(value*100)::bigint as value from events, m where event_id>=lo+(hi-lo)//4 and event_id<lo+3*(hi-lo)//4 order by 1 desc",
    "map_upsert": "with n as (select event_id+500 k, -floor(value*100)::bigint v from events where event_id>=500), o as (select event_id k, floor(value*100)::bigint v from events) select coalesce(o.k,n.k) as key, case when o.v is null then n.v when n.v is null then o.v else o.v+n.v end as value from o full join n on o.k=n.k",
    "map_log": "select k as key, v as value from (select event_id*7919%200 k, arg_max(event_id, event_id) v, arg_max(event_type, event_id) t from events group by 1) where t<>'error'",
    "first_last_key": "with k as (select event_id as key, floor(value*100)::bigint as value from events) select * from (select *, 'first' which from k order by key limit 1) union all select * from (select *, 'second' from k order by key limit 1 offset 1) union all select * from (select *, 'last' from k order by key desc limit 1)",
    "as_of_connected": _r(LOG, """q as materialized (select user_id*10+k qid, (m*k)//10 t, user_id*3%2003 u, user_id*5%1999 v from (select distinct user_id from events), (select max(event_id) m from events), (select unnest(range(1,11)) k)),
ts as (select distinct t from q),
a as materialized (select t, u s, v d from el join ts on born<=t and dies>t union all select t, v, u from el join ts on born<=t and dies>t),
cc(t,v,comp) using key (t,v) as (
  select t, x, x from vl join ts on born<=t and dies>t
  union
  select a.t, a.d, min(cc.comp) from cc join a on a.s=cc.v and a.t=cc.t join recurring.cc r on r.v=a.d and r.t=a.t where cc.comp<r.comp group by a.t, a.d)""", "select qid, coalesce(x.comp=y.comp,false) connected from q left join cc x on x.t=q.t and x.v=u left join cc y on y.t=q.t and y.v=q.v"),
    "remove_edge_snapshot": _r(LOG, SIDES, """g as materialized (select r.seq, r.eid, l.u, l.v from lo r join el l on l.eid=r.eid and l.dies=r.seq where r.op='remove_edge'),
w(seq,x) as (
  select seq, u from g
  union
  select w.seq, sd.d from w join sd on sd.s=w.x where sd.born<w.seq and sd.dies>w.seq)""", "select g.seq, eid edge_id, w.seq is null was_bridge from g left join w on w.seq=g.seq and w.x=g.v"),
    "remove_vertex_snapshot": _r(LOG, SIDES, """g as materialized (select seq, u x from lo join vl on x=u and dies=seq where op='remove_vertex'),
nb as materialized (select distinct g.seq, sd.d y from g join sd on sd.s=g.x and sd.dies=g.seq),
w(seq,y,x) as (
  select seq, y, y from nb
  union
  select w.seq, w.y, sd.d from w join sd on sd.s=w.x where sd.born<w.seq and sd.dies>w.seq),
rp as (select seq, y from nb where not exists (select 1 from w where w.seq=nb.seq and w.x=nb.y and w.y<nb.y))""", "select g.seq, x vertex_id, coalesce(string_agg(y::varchar, ',' order by y), '') parts from g left join rp on rp.seq=g.seq group by 1,2"),
    "edge_lives": _r(LOG, "select eid edge_id, u, v, born, dies from el"),
    "snapshot_edges": _r(LOG, "h as (select max(seq)//2 t from lo)", "select eid edge_id, u, v from el, h where born<=t and dies>t"),
    "vertex_removal": _r(PS, "g as (select 2*s_suppkey+1 x from supplier where s_suppkey<=10), k as (select * from e where v not in (select x from g))", "select y vertex_id, count(k.e) degree from (select distinct u y from e union select distinct v from e where v not in (select x from g)) left join k on k.u=y or k.v=y group by 1"),
    "path_lca": _r(H, "select hq.qid, case when hq.u=hq.v then hq.u when x.v=y.v then x.v when nx.v=ny.v then nx.v end lca, case when hq.u=hq.v then 0 when x.v=y.v then 2 when nx.v=ny.v then 4 end::bigint path_len from hq join he x on x.e=hq.u join he y on y.e=hq.v join he nx on nx.e=x.v join he ny on ny.e=y.v"),
    "label_fold": "select n_regionkey+1000000000000 component_id, count(*) n, sum(c_custkey%13)::bigint total from customer join nation on n_nationkey=c_nationkey where c_acctbal>0 group by 1",
    "point_incident_mask": _r(HC, "m as (select hq.qid, pt.l, part from hq join pt on pt.x=hq.u)", "select hq.qid, coalesce(bit_or(1::bigint << (lab.l+1)),0)::bigint mask from hq left join m using(qid) left join pt on pt.l=m.l and pt.part=m.part left join lab on lab.x=pt.x and lab.l=pt.l group by 1"),
    "tag_compositions": """with t as (select unnest(range(16)) i), p as (select unnest([-1,0,1,3,5,6,32,2147483647]) x),
one as (select a.i, b.i j, x, a.i%8-1 la, b.i%8-1 lb from t a, t b, p),
two as (select *, case when x=2147483647 then x when i>=8 then case when x<=la then -1 else x end else greatest(x,la) end y from one)
select i, j, x::int probe, case when y=2147483647 then y when j>=8 then case when y<=lb then -1 else y end else greatest(y,lb) end::int as after from two""",
    "size_vectors": "select n_regionkey+1000000000000 component_id, ((c_custkey+3000000000000)%4-1)::int as level, count(*) size from customer join nation on n_nationkey=c_nationkey where (c_custkey+3000000000000)%4-1<=1 group by 1,2",
    "part_entries": """with s as (select n_regionkey+1000000000000 r, (c_custkey+3000000000000)%4-1 l, count(*) n from customer join nation on n_nationkey=c_nationkey group by 1,2),
m as (select n_regionkey+1000000000000 r, bit_or(1::bigint << (c_custkey%3+1)) m from customer join nation on n_nationkey=c_nationkey where c_acctbal>0 group by 1)
select r component_id, string_agg(l||':'||n, ',' order by l) sizes, any_value(coalesce(m,0))::bigint mask from s left join m using(r) group by 1""",
    "range_fold": """with k as (select * from (values (0,'included'),(1,'excluded'),(2,'unbounded')) t(i,n)), u as (select distinct user_id from events),
r as (select (user_id*9+a.i*3+b.i)::bigint rid, user_id*40 lo, a.n lk, user_id*60-100 hi, b.n hk from u, k a, k b)
select rid, max(floor(value*100)::bigint) most from r left join events on (lk='unbounded' or event_id>lo or (lk='included' and event_id=lo)) and (hk='unbounded' or event_id<hi or (hk='included' and event_id=hi)) group by 1""",
    "map_insert_returns": """with l as (select event_id seq, event_type t, event_id*7919%200 k from events), p as (select seq, lag(t) over w t, lag(seq) over w v from l window w as (partition by k order by seq))
select seq, coalesce(t<>'error', false) was_there, case when t<>'error' then v end as old from p""",
    "map_totals": "with " + KV + """ select count(*) len, false is_empty, sum(v)::bigint total, min(v) least, max(v) most, 'all' as of, true equal_to_itself, false equal_without_first from kv
union all select 0, true, null, null, null, 'cleared', true, false""",
    "map_get": "with " + KV + " select ask.k as key, kv.k is not null is_there, v as value from ask left join kv using(k)",
    "map_or_insert": "with " + KV + " select k as key, v as value from kv union all select k, k*2 from ask where k not in (select k from kv)",
    "map_or_default": "with " + KV + " select k as key, v as value from kv union all select k, 0 from ask where k not in (select k from kv)",
    "map_and_modify": "with " + KV + " select k as key, case when k in (select k from ask) then v*3+1 else v end as value from kv",
    "map_update_or_insert": "with " + KV + " select k as key, case when k in (select k from ask) then v+7 else v end as value from kv union all select k, -5 from ask where k not in (select k from kv)",
    "map_update_remove": "with " + KV + " select k as key, case when v<0 or v>10000 then k else v end as value from kv where k<9000",
    "map_ends": "with " + KV + " select 'keys' what, min(k) front, max(k) back from kv union all select 'values', arg_min(v, k), arg_max(v, k) from kv",
    "add_vertices": _r(PS, ALLV, "select x vertex_id from av"),
    "remove_isolated_vertices": _r(PS, ALLV, "dg as (select u x from e union select v from e)", "select x vertex_id, x%2=0 refused from av where x in (select x from dg) or x%2=1"),
    "link": _r(PS, ALLV, NEW, "select e edge_id, u, v from nw where u<>v and v in (select x from av)"),
    "self_loops": "with " + NEW + " select e edge_id, u from nw where u=v",
    "remove_edges": _r(PS, "select e edge_id, u, v from e where e%2=1"),
    "cut_edges": _r(PS, "select e edge_id, u, v, w weight from e where v=2*((u//2)%100)+1"),
    "cut_degrees": _r(PS, "k as (select * from e where v<>2*((u//2)%100)+1)", "select y vertex_id, count(k.e) degree from (select u y from e union select v from e) left join (select u x, e from k union all select v, e from k) k on k.x=y group by 1"),
    "forest_link": _r(H, """rg as (select e, v r from he where e<3000000000000), cu as (select he.e, rg.r from he join rg on rg.e=he.v where he.e>=3000000000000),
e as materialized (select qid e, least(a.r,b.r) u, greatest(a.r,b.r) v from hq join cu a on a.e=hq.u join cu b on b.e=hq.v where a.r<>b.r)""", KRUSKAL, "select qid+4000000000000 edge_id, qid in (select e from tr) taken from hq"),
    "label_log": "with " + LABELS + " select k label_id, k%500+3000000000000 vertex_id, (k%4)::int as level, w weight from lv",
    "label_changes": "with " + OLD + """, nl as (select c_custkey+1000000 id, c_custkey+3000000000000 x, 0 l, case when c_custkey%3=0 then -c_custkey else c_custkey end w from customer where c_custkey%9<>0)
select id label_id, x vertex_id, l::int as level, w weight from ol where id%2=1 union all select id, x, l, w from nl""",
    "label_vertex": "with " + OLD + " select c_custkey label_id, x vertex_id from customer left join ol on id=c_custkey",
    "first_label_at": _r(H, LABELS, "vx as (select u x from he union select v from he)", "select x vertex_id, min(k) label_id from vx left join lv on lv.k%500+3000000000000=x group by 1"),
    "into_vertex": _r(H, OLD, "select x as id, x vertex_id from (select u x from he union select v from he) union all select c_custkey, coalesce(x, c_custkey) from customer left join ol on id=c_custkey"),
    "leaf_payloads": _r(H, OLD, "select 'edge' kind, e leaf_id, w edge_weight, null::bigint label_weight from he union all select 'label', id, null, w from ol"),
    "incident_leaves": _r(H, OLD, "select u vertex_id, 'edge' kind, e leaf_id, w weight from he union all select v, 'edge', e, w from he union all select x, 'label', id, w from ol"),
    "leaf_ranges": _r(H, OLD, """rg as (select e, v r from he where e<3000000000000), tr as (select e x, r from rg union all select he.e, rg.r from he join rg on rg.e=he.v where he.e>=3000000000000),
lf as (select r, 'edge' kind, e id from he join tr on tr.x=he.e union all select r, 'label', id from ol join tr on tr.x=ol.x)""", "select r component_id, kind, id leaf_id, row_number() over (partition by r order by kind, id)-1 place, row_number() over (partition by r order by kind desc, id desc)-1 place_from_end from lf"),
    "degrees": _r(H, OLD, "al as (select u x from he union all select v from he union all select x from ol)", "select x vertex_id, count(*) degree, count(*)>=2 is_boundary, count(*)<=2 is_degree_leq_two, count(*)>=3 is_at_least_n, count(*)=3 is_exactly_n from al group by 1"),
    "counts": _r(H, OLD, "select (select count(*) from (select u from he union select v from he)) vertices, (select count(*) from he) edges, (select count(*) from ol) labels"),
}
